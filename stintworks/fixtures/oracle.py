"""The same results as plain SQL over the driver's views, for the side-by-side check."""

from __future__ import annotations

from stintworks.operators.views import BASE_COLUMNS
from stintworks.schemas import CSV_COLUMNS, FEATURE_LABELS, FEATURES, ROLE_FEATURES, STAGING, SUMMED
from stintworks.sources.api_documents import FACT_PATHS

# Staging rows: the mapping of FIXTURES.md, part B.
STG = """
ent AS (
  SELECT c.c_custkey AS k, n.c_name AS player_name,
         CAST(1975 + (c.c_custkey // 10) % 20 AS INTEGER) AS born_year,
         'n' || ((c.c_custkey // 10) % 25) || ' NAT' || ((c.c_custkey // 10) % 25) AS nation_raw,
         'n' || ((c.c_custkey // 10) % 25) AS nation_country_code,
         'NAT' || ((c.c_custkey // 10) % 25) AS nation_fifa_code,
         CASE c.c_custkey % 20 WHEN 0 THEN 'GK' WHEN 1 THEN 'FW' WHEN 2 THEN 'FW' WHEN 3 THEN 'FW'
           WHEN 4 THEN 'FW' WHEN 5 THEN 'FW,MF' WHEN 6 THEN 'MF,FW' WHEN 7 THEN 'MF' WHEN 8 THEN 'MF'
           WHEN 9 THEN 'MF' WHEN 10 THEN 'DF,MF' WHEN 11 THEN 'MF,DF' WHEN 16 THEN 'DF,FW'
           WHEN 17 THEN 'FW,DF' WHEN 18 THEN '' WHEN 19 THEN NULL ELSE 'DF' END AS position_raw
  FROM customer c
  JOIN customer n ON n.c_custkey = CASE WHEN c.c_custkey % 10 = 9 THEN c.c_custkey - 9 ELSE c.c_custkey END
),
nat AS (
  SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_name) AS place FROM nation
),
raw AS (
  SELECT o.o_custkey AS k, CAST(year(o.o_orderdate) AS INTEGER) AS season, n.place, n.n_nationkey,
         n.n_name AS squad_name, r.r_name AS competition_name,
         count(DISTINCT l_orderkey) AS appearances,
         count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN l_orderkey END) AS starts,
         CAST(sum(l_quantity) * 10 AS BIGINT) AS quantity10,
         count(*) FILTER (l_returnflag = 'R') AS goals,
         count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS non_penalty_goals,
         count(*) FILTER (l_returnflag = 'A') AS assists,
         count(*) AS shots,
         count(*) FILTER (l_linestatus = 'O') AS shots_on_target,
         CAST(sum(l_linenumber) AS BIGINT) AS crosses,
         count(*) FILTER (l_quantity >= 25) AS fouls_drawn,
         count(*) FILTER (l_quantity < 10) AS fouls_committed,
         count(*) FILTER (l_discount >= 0.05) AS tackles_won,
         count(*) FILTER (l_tax >= 0.04) AS interceptions,
         count(*) FILTER (o_orderpriority = '1-URGENT') AS offsides,
         count(*) FILTER (l_quantity >= 45) AS yellow_cards,
         count(*) FILTER (l_quantity = 50) AS red_cards
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nat n ON n.n_nationkey = s.s_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  GROUP BY ALL
),
stg AS (
  SELECT (raw.k * 10000 + season) * 100 + place AS id, raw.*, e.* EXCLUDE (k),
         sha256(player_name || '|' || born_year || '|' || nation_raw) AS source_player_key,
         CASE WHEN raw.k % 50 <> 7 THEN quantity10 END AS minutes,
         goals - non_penalty_goals AS penalties_scored,
         goals - non_penalty_goals AS penalties_attempted,
         goals + assists AS goal_contributions,
         season - born_year AS age, CAST(season AS VARCHAR) AS season_label
  FROM raw JOIN ent e ON e.k = raw.k
)"""

OVR = """
shared AS (
  SELECT sha256(player_name || '|' || born_year || '|' || nation_raw) AS source_player_key
  FROM ent WHERE (k // 10) % 2 = 0 GROUP BY 1 HAVING count(*) > 1
),
ovr AS (
  SELECT DISTINCT source_player_key, season, squad_name, competition_name,
         source_player_key || CASE WHEN n_nationkey < 13 THEN ':A' ELSE ':B' END AS canonical_player_key,
         player_name AS canonical_player_name,
         'shared name, birth year and nation' AS resolution_reason
  FROM stg JOIN shared USING (source_player_key)
),
res AS (
  SELECT s.*, coalesce(o.canonical_player_key, s.source_player_key) AS canonical_player_key,
         coalesce(o.canonical_player_name, s.player_name) AS canonical_player_name,
         o.canonical_player_key IS NOT NULL AS identity_overridden
  FROM stg s LEFT JOIN ovr o USING (source_player_key, season, squad_name, competition_name)
)"""

GROUP = """CASE WHEN position_raw IN ('MF,FW','FW,MF') THEN 'FW_MF' WHEN position_raw IN ('DF,MF','MF,DF') THEN 'DF_MF'
  WHEN position_raw IN ('DF,FW','FW,DF') THEN 'DF_FW' WHEN position_raw IN ('FW','MF','DF','GK') THEN position_raw
  ELSE 'UNKNOWN' END"""


def per90(measure: str, minutes: str = "minutes") -> str:
    """Integer arithmetic, half away from zero, scale 4."""
    return (
        f"CASE WHEN {minutes} > 0 THEN CAST(CAST(floor((2 * coalesce({measure}, 0) * 900000 + {minutes}) "
        f"// (2 * {minutes})) AS BIGINT) AS DOUBLE) / 10000 END"
    )


def canon(source: str, key: str, name: str, out: str = "canon") -> str:
    sums = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in SUMMED)
    rates = ", ".join(f"{per90(f.removesuffix('_per90'))} AS {f}" for f in FEATURES)
    key_out = key if key == "source_player_key" else f"{key}, source_player_key"
    extra = "" if key == "source_player_key" else "max(source_player_key) AS source_player_key,"
    return f"""
{out}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {key}, season ORDER BY minutes DESC NULLS LAST, id) AS stint_rank
  FROM {source}
),
{out}_totals AS (
  SELECT {key}, season, {extra} max(season_label) AS season_label, CAST(max(age) AS DOUBLE) AS age,
         max(born_year) AS born_year, count(*) AS stint_count,
         string_agg(DISTINCT squad_name, ' | ' ORDER BY squad_name) AS squad_names,
         string_agg(DISTINCT competition_name, ' | ' ORDER BY competition_name) AS competition_names,
         {sums}
  FROM {source} GROUP BY {key}, season
),
{out}_joined AS (
  SELECT a.*, p.{name} AS player_name, p.nation_raw, p.nation_country_code, p.nation_fifa_code,
         p.position_raw, {GROUP.replace('position_raw', 'p.position_raw')} AS position_group,
         p.squad_name AS primary_squad_name, p.competition_name AS primary_competition_name
  FROM {out}_totals a JOIN {out}_ranked p ON p.{key} = a.{key} AND p.season = a.season AND p.stint_rank = 1
),
{out} AS (
  SELECT {key_out}, season, season_label, player_name, nation_raw, nation_country_code, nation_fifa_code,
         position_raw, position_group, primary_squad_name, primary_competition_name, squad_names,
         competition_names, stint_count, age, born_year, {", ".join(SUMMED)},
         coalesce(minutes >= 900 AND position_raw <> 'GK', FALSE) AS is_similarity_eligible,
         CASE WHEN minutes >= 1800 THEN 'HIGH' WHEN minutes >= 900 THEN 'MEDIUM' ELSE 'LOW' END AS sample_quality,
         {rates}
  FROM {out}_joined
)"""


CANON = canon("res", "canonical_player_key", "canonical_player_name")


def query(ctes: list[str], body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


RESOLVED = [STG, OVR]
CANONICAL = [STG, OVR, CANON]


F10 = range(len(FEATURES))
POP = """
pop AS (
  SELECT *, season || '|' || position_group AS cohort, {x} FROM canon
  WHERE is_similarity_eligible AND position_group <> 'GK'
),
mom AS (
  SELECT season, position_group, count(*) AS n, {sums} FROM pop GROUP BY season, position_group
),
z AS (
  SELECT p.canonical_player_key AS key, p.season, p.position_group, p.cohort, p.player_name, p.primary_squad_name,
         p.primary_competition_name, p.position_raw, p.minutes, p.stint_count, m.n, {z}
  FROM pop p JOIN mom m ON m.season = p.season AND m.position_group = p.position_group
)""".format(
    x=", ".join(f"CAST(round({f} * 10000) AS HUGEINT) AS x{i}" for i, f in enumerate(FEATURES)),
    sums=", ".join(f"sum(x{i}) AS s{i}, sum(x{i} * x{i}) AS q{i}" for i in F10),
    z=", ".join(
        f"(CAST(x{i} AS DOUBLE) - CAST(s{i} AS DOUBLE) / n) / "
        f"(CASE WHEN n * q{i} - s{i} * s{i} = 0 THEN 10000.0::DOUBLE ELSE sqrt(CAST(n * q{i} - s{i} * s{i} AS DOUBLE)) / n END) AS z{i}"
        for i in F10
    ),
)


def plus(terms) -> str:
    return " + ".join(terms)


def norm(alias: str) -> str:
    return "sqrt(" + plus(f"{alias}.z{i} * {alias}.z{i}" for i in F10) + ")"


GAP2 = plus(f"(t.z{i} - c.z{i}) * (t.z{i} - c.z{i})" for i in F10)
PAIRS = f"""
pairs AS MATERIALIZED (
  SELECT t.key || '|' || t.season AS target_id, t.position_group AS target_group, t.n, t.player_name AS target_name,
         c.key, c.season, c.player_name,
         sqrt({GAP2}) AS euclidean,
         {plus(f"abs(t.z{i} - c.z{i})" for i in F10)} AS manhattan,
         CASE WHEN {norm('t')} * {norm('c')} = 0 THEN 0
              ELSE ({plus(f"t.z{i} * c.z{i}" for i in F10)}) / ({norm('t')} * {norm('c')}) END AS cosine
  FROM z t JOIN z c ON c.cohort = t.cohort AND c.key <> t.key
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(euclidean, 6), key, season) AS euclidean_rank,
         row_number() OVER (PARTITION BY target_id ORDER BY round(manhattan, 6), key, season) AS manhattan_rank,
         row_number() OVER (PARTITION BY target_id ORDER BY round(cosine, 6) DESC, key, season) AS cosine_rank
  FROM pairs
)"""
SPACE = [*CANONICAL, POP]
RANKED = [*SPACE, PAIRS]


def knn(metric: str, k: int) -> str:
    return query(
        RANKED,
        f"SELECT target_id, key, season, CAST({metric}_rank AS INTEGER) AS rank, round({metric}, 6) AS score "
        f"FROM ranked WHERE {metric}_rank <= {k} AND n >= 3",
    )


REQ = """
req AS (
  SELECT o_orderkey AS request_id,
         CASE o_orderkey % 6 WHEN 1 THEN '  ' || upper(e.player_name) || ' '
           WHEN 3 THEN substr(e.player_name, 1, length(e.player_name) - 2)
           WHEN 4 THEN e.player_name || ' x' ELSE e.player_name END AS name,
         CASE WHEN o_orderkey % 6 = 2 THEN n_name END AS club,
         CASE WHEN o_orderkey % 6 <> 5 THEN CAST(year(o_orderdate) AS INTEGER) END AS season,
         CAST((o_orderkey // 6) % 52 AS INTEGER) AS k
  FROM orders JOIN ent e ON e.k = o_custkey JOIN nation ON n_nationkey = (o_orderkey // 6) % 25
),
asked AS (SELECT *, lower(trim(name)) AS lname, lower(trim(club)) AS lclub FROM req),
hits AS (
  SELECT a.request_id, c.*, a.lclub IS NULL OR lower(c.primary_squad_name) = a.lclub AS club_ok
  FROM asked a JOIN canon c ON lower(c.player_name) = a.lname AND (a.season IS NULL OR a.season = c.season)
),
tally AS (
  SELECT request_id, count(*) AS by_name, count(*) FILTER (club_ok) AS by_club FROM hits GROUP BY request_id
),
outcome AS (
  SELECT a.*, coalesce(by_club, 0) AS matches,
         CASE WHEN {valid} THEN
           CASE WHEN by_name IS NULL THEN 'NOT_FOUND' WHEN by_club = 0 THEN 'CLUB_MISMATCH'
                WHEN by_club > 1 THEN 'AMBIGUOUS' ELSE 'OK' END ELSE 'INVALID' END AS status
  FROM asked a LEFT JOIN tally USING (request_id)
),
matched AS (
  SELECT o.request_id, o.name, o.club, o.k, o.status AS resolved_status, o.matches, h.* EXCLUDE (request_id, club_ok)
  FROM outcome o LEFT JOIN hits h ON h.request_id = o.request_id AND h.club_ok AND o.status = 'OK'
)"""
REQ_WITH_K = REQ.replace("{valid}", "a.k BETWEEN 1 AND 50")
REQ_ANY = REQ.replace("{valid}", "TRUE")
DETAIL = """CASE status WHEN 'INVALID' THEN 'The limit must be between 1 and 50 and the name must be given.'
  WHEN 'NOT_FOUND' THEN 'Player "' || name || '" was not found.'
  WHEN 'CLUB_MISMATCH' THEN 'Player "' || name || '" was found, but not with primary club "' || club || '".'
  WHEN 'AMBIGUOUS' THEN 'Multiple canonical players match "' || name || '" (' || matches || '). Specify the club parameter.'
  WHEN 'NOT_ELIGIBLE' THEN 'Player "' || player_name || '" exists, but is not eligible for similarity analysis. Position: '
       || coalesce(position_raw, 'null') || '. Current minutes: ' || minutes || '. Minimum required: 900.'
  WHEN 'COHORT_TOO_SMALL' THEN 'Not enough eligible players in cohort ' || position_group || '.' END"""
CODE = "CASE status WHEN 'OK' THEN 200 WHEN 'NOT_FOUND' THEN 404 WHEN 'CLUB_MISMATCH' THEN 400 WHEN 'AMBIGUOUS' THEN 400 WHEN 'COHORT_TOO_SMALL' THEN 500 ELSE 422 END"
SIMILAR = """
sized AS (
  SELECT m.*, CASE WHEN resolved_status = 'OK' AND NOT is_similarity_eligible THEN 'NOT_ELIGIBLE'
                   WHEN resolved_status = 'OK' AND c.n < 3 THEN 'COHORT_TOO_SMALL' ELSE resolved_status END AS status
  FROM matched m LEFT JOIN mom c ON c.season = m.season AND c.position_group = m.position_group
)"""

GROUPED = f"grp AS (SELECT *, {GROUP} AS position_group FROM stg)"
COLLISIONS = """SELECT source_player_key, season, count(*) AS stint_count, count(DISTINCT squad_name) AS squad_count,
  count(DISTINCT position_group) AS group_count, string_agg(DISTINCT squad_name, ' | ' ORDER BY squad_name) AS squad_names
  FROM grp GROUP BY source_player_key, season HAVING count(DISTINCT squad_name) > 1 AND count(DISTINCT position_group) > 1"""
BASE_RATES = ["goals", "assists", "goal_contributions", "non_penalty_goals", "crosses", "tackles_won", "interceptions",
              "fouls_drawn", "fouls_committed", "offsides", "yellow_cards", "red_cards"]
# Staging columns that the fixture fills; the others are NULL of their type.
FILLED = {"id", "source_row_number", "source_player_key", "player_name", "nation_raw", "nation_country_code", "nation_fifa_code", "position_raw",
          "squad_name", "competition_name", "season", "season_label", "age", "born_year", *SUMMED}
_SQL_TYPES = {"long": "BIGINT", "integer": "INTEGER", "string": "VARCHAR", "decimal": "DOUBLE", "timestamp": "TIMESTAMP"}
_STAGED = {f.name: _SQL_TYPES[f.dataType.typeName()] for f in STAGING.fields}


def staged(column: str, value: str | None = None) -> str:
    source = value or (column if column in FILLED else "NULL")
    return f"CAST({source} AS {_STAGED[column]}) AS {column}"


BASE = f"""SELECT {", ".join("position_group" if c == "position_group" else staged(c) for c in BASE_COLUMNS)},
  CASE position_group WHEN 'GK' THEN 'GOALKEEPER' WHEN 'DF' THEN 'DEFENDER' WHEN 'DF_MF' THEN 'DEFENSIVE_HYBRID'
    WHEN 'MF' THEN 'MIDFIELDER' WHEN 'FW_MF' THEN 'ATTACKING_HYBRID' WHEN 'FW' THEN 'FORWARD'
    WHEN 'DF_FW' THEN 'OTHER_HYBRID' ELSE 'UNKNOWN' END AS role_family,
  coalesce(minutes, 0) >= 900 AND position_group <> 'UNKNOWN' AS is_similarity_eligible,
  CASE WHEN coalesce(minutes, 0) >= 1800 THEN 'HIGH' WHEN coalesce(minutes, 0) >= 900 THEN 'MEDIUM' ELSE 'LOW' END AS sample_quality,
  {", ".join(f"CASE WHEN minutes > 0 THEN 0.0::DOUBLE END AS {m}_per90" for m in ("saves", "shots_on_target_against", "clean_sheets"))},
  {", ".join(f"{per90(m)} AS {m}_per90" for m in BASE_RATES)} FROM grp"""


def scaled(top: str, bottom: str, factor: int) -> str:
    """``round(top * factor / bottom, 2)`` in integers, half away from zero; tops are not negative."""
    return (f"CASE WHEN {bottom} <> 0 THEN CAST(((2 * ({top}) * {factor} * 100 + {bottom}) // (2 * {bottom})) AS BIGINT) / 100.0::DOUBLE END")


STAR = f"""
SELECT player_id, CAST(player_id AS INTEGER) AS api_football_id, c_name AS player_name, h.n_name AS nationality, CAST(f.n_nationkey AS BIGINT) AS team_id,
  squad_name AS team_name, CAST(r_regionkey AS BIGINT) AS competition_id, competition_name, CAST(NULL AS VARCHAR) AS competition_country,
  season, position_raw AS position, CAST(appearances AS INTEGER) AS appearances, CAST(starts AS INTEGER) AS starts, CAST(minutes AS INTEGER) AS minutes,
  6 + round(starts * 25) / 100.0::DOUBLE AS rating, CAST(g AS INTEGER) AS goals, CAST(assists AS INTEGER) AS assists, CAST(penalties_scored AS INTEGER) AS penalties_scored,
  0 AS penalties_missed, CAST(shots AS INTEGER) AS shots_total, CAST(shots_on_target AS INTEGER) AS shots_on, CAST(crosses * 3 AS INTEGER) AS passes_total,
  CAST(keyp AS INTEGER) AS passes_key, CAST(duels AS INTEGER) AS duels_total, CAST(fouls_drawn AS INTEGER) AS duels_won, CAST(dribbles AS INTEGER) AS dribbles_attempts,
  CAST(tackles_won AS INTEGER) AS dribbles_success,
  {scaled('g', 'minutes', 90)} AS goals_per_90, {scaled('assists', 'minutes', 90)} AS assists_per_90,
  CAST(coalesce(g, 0) + assists AS INTEGER) AS goal_contributions,
  {scaled('coalesce(g, 0) + assists', 'minutes', 90)} AS goal_contributions_per_90,
  {scaled('shots', 'minutes', 90)} AS shots_per_90, {scaled('shots_on_target', 'minutes', 90)} AS shots_on_per_90,
  {scaled('shots_on_target', 'shots', 100)} AS shots_on_pct, {scaled('g', 'shots', 100)} AS goal_conversion_pct,
  {scaled('minutes', 'g', 1)} AS minutes_per_goal,
  CAST(coalesce(g, 0) - penalties_scored AS INTEGER) AS non_penalty_goals,
  CASE WHEN minutes > 0 THEN CAST(sign(coalesce(g, 0) - penalties_scored) * ((2 * abs(coalesce(g, 0) - penalties_scored) * 9000 + minutes) // (2 * minutes)) AS BIGINT) / 100.0::DOUBLE END AS non_penalty_goals_per_90,
  {scaled('keyp', 'minutes', 90)} AS key_passes_per_90,
  {scaled('tackles_won', 'dribbles', 100)} AS dribble_success_pct, {scaled('fouls_drawn', 'duels', 100)} AS duels_won_pct
FROM (SELECT s.* EXCLUDE (minutes), CAST(minutes AS BIGINT) AS minutes, id // 1000000 AS player_id,
        CASE WHEN k % 11 <> 0 THEN goals END AS g, CASE WHEN k % 7 <> 0 THEN crosses END AS keyp,
        fouls_drawn + fouls_committed AS duels, tackles_won + interceptions AS dribbles FROM stg s) f
JOIN customer c ON c.c_custkey = f.player_id JOIN nation h ON h.n_nationkey = c.c_nationkey
JOIN region r ON r.r_name = f.competition_name"""

SUGGESTED = """
SELECT request_id, CAST(position AS INTEGER) AS position, player_name, primary_squad_name, primary_competition_name FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY player_name, first_key, primary_squad_name, primary_competition_name) AS position
  FROM (SELECT o.request_id, c.player_name, c.primary_squad_name, c.primary_competition_name, min(c.canonical_player_key) AS first_key
        FROM outcome o JOIN canon c ON contains(lower(c.player_name), o.lname) AND (o.season IS NULL OR o.season = c.season)
        WHERE o.status = 'NOT_FOUND' GROUP BY ALL)
) WHERE position <= 10"""
CANDIDATES = """
SELECT DISTINCT o.lname AS lookup_name, o.lclub AS lookup_club, o.season AS lookup_season, c.canonical_player_key, c.season,
  c.player_name || ' — ' || c.primary_squad_name || ' — ' || c.primary_competition_name || ' — ' || coalesce(c.position_raw, 'None') || ' — ' || c.minutes || ' min' AS candidate
FROM outcome o JOIN canon c ON lower(c.player_name) = o.lname AND (o.season IS NULL OR o.season = c.season)
  AND (o.lclub IS NULL OR lower(c.primary_squad_name) = o.lclub)
WHERE o.status = 'AMBIGUOUS'"""


def profile_sql(sections: dict[str, dict[str, str]]) -> str:
    fields = [
        (f"CAST(trunc({src}) AS INTEGER)" if src == "age" else src) + f" AS {section}_{out}"
        for section, columns in sections.items() for out, src in columns.items()
    ]
    return f"SELECT request_id, status, {DETAIL} AS detail, {', '.join(fields)} FROM (SELECT *, resolved_status AS status FROM matched)"


MOMENTS = "SELECT season, position_group, n AS cohort_size, feature, 0::BIGINT AS missing, round(mean, 6) AS mean, round(std, 6) AS std FROM (" + " UNION ALL ".join(
    f"SELECT season, position_group, n, '{f}' AS feature, CAST(s{i} AS DOUBLE) / n / 10000 AS mean, "
    f"CASE WHEN n * q{i} - s{i} * s{i} = 0 THEN 1.0::DOUBLE ELSE sqrt(CAST(n * q{i} - s{i} * s{i} AS DOUBLE)) / n / 10000 END AS std FROM mom"
    for i, f in enumerate(FEATURES)
) + ")"
SIMILAR_ROWS = """
SELECT s.request_id, s.player_name AS player, CAST(r.euclidean_rank AS INTEGER) AS rank, r.key AS canonical_player_key, z.player_name AS name,
  z.primary_squad_name AS club, z.primary_competition_name AS competition, z.position_raw AS position, z.position_group,
  z.minutes, z.stint_count, round(r.euclidean, 4) AS distance
FROM sized s JOIN ranked r ON r.target_id = s.canonical_player_key || '|' || s.season AND r.euclidean_rank <= s.k
JOIN z ON z.key = r.key AND z.season = r.season WHERE s.status = 'OK'"""
METRIC_TOP = " UNION ALL ".join(
    f"SELECT target_id, '{m}' AS metric, CAST({m}_rank AS INTEGER) AS rank, key, season, round(euclidean, 6) AS euclidean, "
    f"round(manhattan, 6) AS manhattan, round(cosine, 6) AS cosine FROM ranked WHERE {m}_rank <= 10"
    for m in ("euclidean", "manhattan", "cosine")
)
DIAGNOSTIC = """
SELECT t.target_id, r.key AS other_key, r.season AS other_season, round(euclidean, 6) AS euclidean, round(manhattan, 6) AS manhattan,
  round(cosine, 6) AS cosine, euclidean_rank, manhattan_rank, cosine_rank,
  CASE WHEN r.key IS NULL THEN 'CANDIDATE_NOT_FOUND' ELSE 'OK' END AS status
FROM (SELECT key || '|' || season AS target_id, season, key, min(player_name) OVER (PARTITION BY cohort) AS first_name FROM z) t
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY target_id, player_name ORDER BY key, season) AS nth FROM ranked) r
  ON r.target_id = t.target_id AND t.season % 2 = 0 AND r.player_name = t.first_name AND r.nth = 1"""


def _explained(metric: str, rank: int, columns: str) -> str:
    parts = [
        f"SELECT r.target_id, r.key, r.season, CAST(r.{metric}_rank AS INTEGER) AS rank, {i} AS place, '{f}' AS feature, "
        f"t.z{i} AS tz, c.z{i} AS cz, {GAP2} AS squared, {norm('t')} * {norm('c')} AS norms, r.euclidean AS distance, r.cosine AS cosine "
        f"FROM ranked r JOIN z t ON t.key || '|' || t.season = r.target_id JOIN z c ON c.key = r.key AND c.season = r.season "
        f"WHERE r.{metric}_rank = {rank} AND r.n >= 3"
        for i, f in enumerate(FEATURES)
    ]
    return f"SELECT target_id, key, season, {columns} FROM ({' UNION ALL '.join(parts)})"


LABEL = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{label}'" for f, label in FEATURE_LABELS.items()) + " END AS label"
EXPLAIN_EUCLIDEAN = _explained("euclidean", 1, f"""rank, feature, {LABEL}, round(tz, 6) AS target_z, round(cz, 6) AS candidate_z,
  round(abs(tz - cz), 6) AS absolute_gap, round((tz - cz) * (tz - cz), 6) AS squared_contribution,
  round(CASE WHEN squared > 0 THEN (tz - cz) * (tz - cz) / squared * 100 ELSE 0 END, 6) AS distance_share_pct, round(distance, 6) AS distance""")
EXPLAIN_COSINE = _explained("cosine", 2, f"""rank, feature, {LABEL}, round(tz, 6) AS target_z, round(cz, 6) AS candidate_z,
  round(abs(tz - cz), 6) AS z_gap, round(tz * cz / norms, 6) AS cosine_contribution,
  CASE WHEN tz > 0 AND cz > 0 THEN 'both above cohort avg' WHEN tz < 0 AND cz < 0 THEN 'both below cohort avg' ELSE 'opposite sides of avg' END AS direction, round(cosine, 6) AS similarity,
  CASE WHEN norms > 0 THEN 'OK' ELSE 'ZERO_VECTOR' END AS status""")
NTH_STATUS = """SELECT z.key || '|' || z.season AS target_id, least(n - 1, 100) AS available,
  CASE WHEN n - 1 >= 100 THEN 'OK' ELSE 'RANK_UNAVAILABLE' END AS status FROM z WHERE n >= 3"""
_BY_COSINE = _explained("cosine", 1, "place, feature, round(tz * cz / norms, 6) AS part, round(abs(tz - cz), 6) AS gap")
_BY = _explained("euclidean", 1, "place, feature, round(abs(tz - cz), 6) AS gap, round((tz - cz) * (tz - cz), 6) AS sq")
TOP_FEATURES = f"""SELECT list, target_id, key, season, CAST(position AS INTEGER) AS position, feature FROM (
  SELECT 'largest' AS list, *, row_number() OVER (PARTITION BY target_id ORDER BY sq DESC, place) AS position FROM ({_BY})
  UNION ALL
  SELECT 'closest' AS list, *, row_number() OVER (PARTITION BY target_id ORDER BY gap, place) AS position FROM ({_BY})
) WHERE position <= 5 UNION ALL SELECT list, target_id, key, season, CAST(position AS INTEGER), feature FROM (
  SELECT 'aligned' AS list, *, row_number() OVER (PARTITION BY target_id ORDER BY part DESC, place) AS position FROM ({_BY_COSINE})
  UNION ALL
  SELECT 'differences' AS list, *, row_number() OVER (PARTITION BY target_id ORDER BY gap DESC, place) AS position FROM ({_BY_COSINE})
) WHERE position <= 5"""
_ROLE_GAP = "CASE t.position_group " + " ".join(
    f"WHEN '{g}' THEN " + plus(f"(t.z{i} - c.z{i}) * (t.z{i} - c.z{i})" for i, f in enumerate(FEATURES) if f in chosen)
    for g, chosen in ROLE_FEATURES.items()
) + " END"
ROLE = f"""
role_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(d, 6), key, season) AS role_rank FROM (
    SELECT t.key || '|' || t.season AS target_id, c.key, c.season, sqrt({_ROLE_GAP}) AS d
    FROM z t JOIN z c ON c.cohort = t.cohort AND c.key <> t.key
    WHERE t.position_group IN ({", ".join(f"'{g}'" for g in ROLE_FEATURES)}))
)"""
OVERLAP = f"""
SELECT z.key || '|' || z.season AS target_id,
  CASE WHEN z.position_group IN ({", ".join(f"'{g}'" for g in ROLE_FEATURES)}) THEN coalesce(o.overlap, 0) END AS overlap,
  CASE WHEN z.position_group IN ({", ".join(f"'{g}'" for g in ROLE_FEATURES)}) THEN 'OK' ELSE 'NO_ROLE_FEATURES' END AS status
FROM z LEFT JOIN (SELECT target_id, count(*) AS overlap FROM ranked r JOIN role_ranked q USING (target_id, key, season)
  WHERE euclidean_rank <= 10 AND role_rank <= 10 GROUP BY target_id) o ON o.target_id = z.key || '|' || z.season"""
EMBEDDING = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 6) DESC, neighbour) AS rank FROM (
    SELECT t.vec_id, c.vec_id AS neighbour,
      CASE WHEN list_dot_product(t.v, t.v) = 0 OR list_dot_product(c.v, c.v) = 0 THEN 0
           ELSE list_dot_product(t.v, c.v) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(c.v, c.v))) END AS s
    FROM e t JOIN e c ON c.label = t.label AND c.vec_id <> t.vec_id)) WHERE rank <= 5"""

API = """
team AS (
  SELECT l_orderkey, n_nationkey, n_name, r_regionkey, r_name, count(*) AS games, CAST(sum(l_quantity) AS BIGINT) AS minutes,
         count(*) FILTER (l_returnflag = 'R') AS goals
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY ALL
),
asked AS (
  SELECT o_orderkey, o_custkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderkey % 10 AS kind, o_orderkey % 5 AS league, c_name,
         lower(substr(c_name, 1, 8)) AS search
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
),
good AS (SELECT * FROM asked JOIN team ON l_orderkey = o_orderkey AND r_regionkey = league WHERE kind > 1)"""
API_REJECTS = query([API], """
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, search, league, season,
  CASE kind WHEN 0 THEN 'API_ERRORS' WHEN 1 THEN 'NO_ENTRIES' ELSE 'NO_STATISTICS' END AS reject_reason,
  CASE kind WHEN 0 THEN '{"token":"expired"}' ELSE '[]' END AS errors
FROM asked WHERE o_orderkey NOT IN (SELECT o_orderkey FROM good)
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), lower(substr(c_name, 1, 8)), o_orderkey % 5, CAST(year(o_orderdate) AS INTEGER), 'NO_DOCUMENT', ''
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
API_SUMMARY = query([API], """
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, n_name AS team_name, r_name AS competition_name, season, CAST(games AS INTEGER) AS appearances,
  CAST(minutes AS INTEGER) AS minutes, CAST(goals AS INTEGER) AS goals, CAST(NULL AS INTEGER) AS assists FROM good""")
API_LATEST = query([API], """
SELECT CAST(o_custkey AS INTEGER) AS entity_api_id, season, max(o_orderdate) AS fetched_at, TRUE AS payload_kept
FROM good GROUP BY ALL""")
CLEAN_INT = """SELECT o_orderkey, CAST(CASE o_orderkey % 10 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 2 THEN -o_custkey WHEN 3 THEN o_custkey
  WHEN 4 THEN o_custkey WHEN 8 THEN -o_custkey WHEN 9 THEN o_custkey * 100 END AS INTEGER) AS value FROM orders"""
CLEAN_DECIMAL = """SELECT o_orderkey, CAST(TRY_CAST(CASE o_orderkey % 10 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey + 0.7 WHEN 2 THEN -o_custkey - 0.7 WHEN 3 THEN o_custkey
  WHEN 4 THEN o_custkey WHEN 7 THEN o_custkey WHEN 8 THEN -o_custkey WHEN 9 THEN o_custkey * 100 END AS DECIMAL(8,2)) AS DOUBLE) AS value FROM orders"""
FIRST_TOKEN = """SELECT o_orderkey, regexp_extract(o_orderpriority, '^(\\S+)', 1) AS code,
  CASE WHEN o_orderpriority LIKE '% %' THEN regexp_extract(o_orderpriority, '^\\S+\\s+(.*)$', 1) ELSE '' END AS rest FROM orders"""
FIRST_INTEGER = "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '\\d+'), '') AS INTEGER) AS brand_number, TRY_CAST(nullif(regexp_extract(p_name, '\\d+'), '') AS INTEGER) AS name_number, p_size AS size FROM part"
BATCH_COUNTS = query([STG], "SELECT season, competition_name, count(*) AS rows FROM stg GROUP BY ALL")
MERGE_UPDATE = """
WITH last AS (SELECT * FROM (SELECT o_custkey * 2 AS key, o_orderpriority AS label, o_totalprice AS amount,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1)
SELECT coalesce(c_custkey, key) AS key, c_name AS name, CASE WHEN key IS NULL THEN c_mktsegment ELSE label END AS label,
  CASE WHEN key IS NULL THEN c_acctbal ELSE amount END AS amount
FROM customer FULL JOIN last ON key = c_custkey"""
MERGE_IGNORE = """
WITH last AS (SELECT * FROM (SELECT o_custkey * 2 AS key, o_orderpriority AS label, o_totalprice AS amount,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1)
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS label, c_acctbal AS amount FROM customer
UNION ALL SELECT key, NULL, label, amount FROM last WHERE key NOT IN (SELECT c_custkey FROM customer)"""
LATEST = """SELECT user_id, event_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""
POOL_SPACE = POP.replace("season || '|' || position_group AS cohort", "position_group AS cohort").replace(
    "SELECT season, position_group, count(*) AS n", "SELECT position_group, count(*) AS n"
).replace("GROUP BY season, position_group", "GROUP BY position_group").replace("m.season = p.season AND ", "")
POOLED = query([*CANONICAL, POOL_SPACE, PAIRS], """SELECT target_id, key, season, CAST(euclidean_rank AS INTEGER) AS rank, round(euclidean, 6) AS score
FROM ranked WHERE euclidean_rank <= 5 AND n >= 3""")


_LAST_KEYED = """SELECT o_custkey * 2 AS key, o_totalprice AS amount FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderkey % 5 <> 0) WHERE n = 1"""
_NO_KEY = "SELECT NULL AS key, NULL AS name, o_totalprice AS amount FROM orders WHERE o_orderkey % 5 = 0"
MERGE_NULL_KEYS = f"""
WITH target AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS key, c_name AS name, c_acctbal AS amount FROM customer),
last AS ({_LAST_KEYED})
SELECT coalesce(t.key, l.key) AS key, name, CASE WHEN l.key IS NULL THEN t.amount ELSE l.amount END AS amount, 'update' AS mode
FROM target t FULL JOIN last l ON t.key = l.key
UNION ALL SELECT *, 'update' FROM ({_NO_KEY})
UNION ALL SELECT *, 'ignore' FROM target
UNION ALL SELECT key, NULL, amount, 'ignore' FROM last WHERE key NOT IN (SELECT key FROM target WHERE key IS NOT NULL)
UNION ALL SELECT *, 'ignore' FROM ({_NO_KEY})"""
_OUTCOME = """SELECT a.o_orderkey, CASE WHEN a.o_orderkey % 7 = 3 THEN 'NO_DOCUMENT' WHEN a.o_orderkey % 11 = 5 THEN 'NO_REQUEST' WHEN kind = 0 THEN 'API_ERRORS'
    WHEN kind = 1 THEN 'NO_ENTRIES' WHEN a.o_orderkey NOT IN (SELECT o_orderkey FROM good) THEN 'NO_STATISTICS' END AS reject_reason
  FROM asked a WHERE NOT (a.o_orderkey % 7 = 3 AND a.o_orderkey % 11 = 5)
  UNION ALL SELECT o_orderkey, 'NO_DOCUMENT' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 11 <> 5"""
API_UNMATCHED = query([API], f"""
SELECT reject_reason, count(*) AS documents, CAST(sum(o_orderkey) AS BIGINT) AS keys
FROM ({_OUTCOME}) WHERE reject_reason IS NOT NULL GROUP BY reject_reason""")
API_BAD_CELLS = query([API], """
, told AS (SELECT CASE WHEN o_orderkey % 9 IN (3, 4) THEN NULL ELSE 'LOADED' END AS outcome,
    minutes + CASE WHEN o_orderkey % 9 = 2 AND minutes % 2 = 1 THEN 1 ELSE 0 END AS minutes FROM good),
gone AS (SELECT CASE WHEN kind = 0 THEN 'API_ERRORS' WHEN kind = 1 THEN 'NO_ENTRIES' WHEN o_orderkey NOT IN (SELECT o_orderkey FROM good) THEN 'NO_STATISTICS'
    WHEN o_orderkey % 9 = 3 THEN 'BAD_NUMBER' WHEN o_orderkey % 9 = 4 THEN 'NO_DIMENSION_KEY' END AS outcome FROM asked
  UNION ALL SELECT 'NO_DOCUMENT' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
SELECT outcome, count(*) AS rows, CAST(sum(minutes) AS BIGINT) AS minutes FROM (
  SELECT * FROM told UNION ALL SELECT outcome, 0 FROM gone) WHERE outcome IS NOT NULL GROUP BY outcome""")

# Requests resolved among the eligible entities, with a rank and a candidate name of their own.
_ELIGIBLE = REQ_ANY.replace("JOIN canon c ON", "JOIN (SELECT * FROM canon WHERE is_similarity_eligible AND position_group <> 'GK') c ON")
SERVED = """
served AS (
  SELECT s.request_id, s.name, s.status, s.canonical_player_key || '|' || s.season AS target_id, s.position_group, c.n, s.season, s.matches, s.club, s.player_name,
         s.position_raw, s.minutes, CAST(1 + s.request_id % 90 AS INTEGER) AS rank, e.player_name AS candidate
  FROM sized s LEFT JOIN mom c ON c.season = s.season AND c.position_group = s.position_group JOIN ent e ON e.k = s.request_id % 40 + 1
)"""
BY_REQUEST = [*RANKED, _ELIGIBLE, SIMILAR, SERVED]
COMPARE_REQUESTS = query(BY_REQUEST, " UNION ALL ".join(
    f"SELECT request_id, '{m}' AS metric, CAST({m}_rank AS INTEGER) AS rank, r.key, r.season, round(r.{m}, 6) AS score "
    f"FROM served s JOIN ranked r USING (target_id) WHERE s.status = 'OK' AND {m}_rank <= 3" for m in ("euclidean", "manhattan", "cosine")))
_RANKED_STATUS = "CASE WHEN status = 'OK' AND n - 1 < rank THEN 'RANK_UNAVAILABLE' ELSE status END"
EXPLAIN_OUTCOMES = query(BY_REQUEST, f"""
SELECT request_id, new_status AS status, CAST(CASE new_status WHEN 'RANK_UNAVAILABLE' THEN 400 ELSE {CODE} END AS INTEGER) AS status_code,
  CASE new_status WHEN 'RANK_UNAVAILABLE' THEN 'Only ' || (n - 1) || ' similar players were available.' ELSE {DETAIL} END AS detail
FROM (SELECT *, {_RANKED_STATUS} AS new_status FROM served)""")
EXPLAIN_MIXED = EXPLAIN_OUTCOMES.replace(
    "CAST(1 + s.request_id % 90 AS INTEGER) AS rank", "CASE WHEN s.request_id % 97 = 5 THEN 1000000 ELSE CAST(1 + s.request_id % 90 AS INTEGER) END AS rank"
)
_WANTED = "wanted AS (SELECT * FROM served WHERE status = 'OK' AND n - 1 >= rank)"


def _for_requests(explained: str) -> str:
    return (
        explained.replace("SELECT r.target_id,", "SELECT w.request_id, r.target_id,")
        .replace("FROM ranked r JOIN z t", "FROM wanted w JOIN ranked r ON r.target_id = w.target_id JOIN z t")
        .replace("SELECT target_id, key, season,", "SELECT request_id, key, season,", 1)
    )


EXPLAIN_REQUESTS = query([*BY_REQUEST, _WANTED], _for_requests(_explained("euclidean", "w.rank", """rank, feature, round(abs(tz - cz), 6) AS absolute_gap,
  round((tz - cz) * (tz - cz), 6) AS squared_contribution, round(distance, 6) AS distance""")))
EXPLAIN_REQUESTS_COSINE = query([*BY_REQUEST, _WANTED], _for_requests(_explained("cosine", "w.rank", """rank, feature, round(abs(tz - cz), 6) AS z_gap,
  round(tz * cz / norms, 6) AS cosine_contribution""")))
_HAS_ROLE = f"s.position_group IN ({', '.join(repr(g) for g in ROLE_FEATURES)})"
ROLE_REQUESTS = query([*BY_REQUEST, ROLE], f"""
SELECT request_id, CASE WHEN status = 'OK' AND NOT {_HAS_ROLE} THEN 'NO_ROLE_FEATURES' ELSE status END AS status,
  CASE WHEN status = 'OK' AND {_HAS_ROLE} THEN coalesce(o.overlap, 0) END AS overlap
FROM served s LEFT JOIN (SELECT target_id, count(*) AS overlap FROM ranked r JOIN role_ranked q USING (target_id, key, season)
  WHERE euclidean_rank <= 10 AND role_rank <= 10 GROUP BY target_id) o USING (target_id)""")
DIAGNOSE_REQUESTS = query(BY_REQUEST, """
SELECT request_id, CASE WHEN status = 'OK' AND r.key IS NULL THEN 'CANDIDATE_NOT_FOUND' ELSE status END AS status, r.key AS other_key, r.season AS other_season,
  round(euclidean, 6) AS euclidean, euclidean_rank, manhattan_rank, cosine_rank
FROM served s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY target_id, player_name ORDER BY key, season) AS nth FROM ranked) r
  ON s.status = 'OK' AND r.target_id = s.target_id AND r.player_name = s.candidate AND r.nth = 1""")
RESOLVED_REQUESTS = query([*CANONICAL, REQ_WITH_K], f"""
SELECT m.request_id, status, CAST({CODE} AS INTEGER) AS status_code,
  CASE WHEN offered IS NULL THEN {DETAIL} ELSE 'Player "' || m.name || '" was not found exactly. Possible matches: ' || offered END AS detail,
  m.matches, m.canonical_player_key, m.season, o.lname AS lookup_name, o.lclub AS lookup_club, o.season AS lookup_season
FROM (SELECT *, resolved_status AS status FROM matched) m JOIN (SELECT request_id, lname, lclub, season FROM outcome) o USING (request_id)
LEFT JOIN (SELECT request_id, string_agg(player_name || ' (' || primary_squad_name || ', ' || primary_competition_name || ')', '; ' ORDER BY position) AS offered
  FROM ({SUGGESTED}) GROUP BY request_id) s USING (request_id)""")
AMBIGUOUS_REQUESTS = query([*CANONICAL, REQ_WITH_K], """
SELECT o.request_id, c.canonical_player_key, c.season,
  c.player_name || ' — ' || c.primary_squad_name || ' — ' || c.primary_competition_name || ' — ' || coalesce(c.position_raw, 'None') || ' — ' || c.minutes || ' min' AS candidate
FROM outcome o JOIN canon c ON lower(c.player_name) = o.lname AND (o.season IS NULL OR o.season = c.season)
  AND (o.lclub IS NULL OR lower(c.primary_squad_name) = o.lclub)
WHERE o.status = 'AMBIGUOUS'""")

# Cells that the CSV text writes in a way of its own, or that come from the load.
_LANDED = {
    "position_raw": "coalesce(position_raw, '')", "competition_raw": "'c ' || competition_name", "competition_source_code": "'c'", "source_id": "2",
    "season": "2025", "season_label": "'2025/26'", "plus_minus": "goals",
    "shots_on_target_pct": "((2 * shots_on_target * 1000 + shots) // (2 * shots)) / 10.0::DOUBLE",
}
# Numbers and times that depend on files and clock; queries of their own check them.
NOT_LANDED = ("id", "batch_id", "source_row_number", "payload", "imported_at")
LANDED_COLUMNS = [f.name for f in STAGING.fields if f.name not in NOT_LANDED]
LANDED = f"""SELECT {", ".join(staged(c, _LANDED.get(c)) for c in LANDED_COLUMNS)}, {len(CSV_COLUMNS)} AS payload_cells, TRUE AS payload_kept FROM stg"""
LANDED_ROWS = query([STG], "SELECT 1::BIGINT AS first_number, count(*) AS rows, count(*) AS numbers, count(*) AS ids FROM stg")
LANDED_BATCHES = query([STG], """SELECT 'rows' AS what, count(*) AS value FROM stg UNION ALL SELECT 'counts_fit', 1 UNION ALL SELECT 'names_fit', 1
UNION ALL SELECT 'ids_fit', 1 UNION ALL SELECT 'changed', 0""")
_FACTS = {"position": "'Attacker'", "shirt_number": "7", "appearances": "games", "minutes": "minutes", "rating": "6.76", "goals": "goals", "penalties_committed": "games"}
_FACT_TYPES = {"string": "VARCHAR", "int": "INTEGER", "decimal(5,2)": "DOUBLE"}
_NEWEST = "(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC{more}) AS place FROM good) WHERE place = 1"
API_STATS = query([API], f"""
SELECT CAST(o_custkey AS INTEGER) AS player_id, CAST(r_regionkey AS INTEGER) AS competition_id, CAST(n_nationkey AS INTEGER) AS team_id, 1::BIGINT AS source_id, season,
  {", ".join(f"CAST({_FACTS.get(c, 'NULL')} AS {_FACT_TYPES[kind]}) AS {c}" for c, (_, kind) in FACT_PATHS.items())},
  CAST(o_orderdate AS TIMESTAMP) AS fetched_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at
FROM {_NEWEST.format(keys="o_custkey, r_regionkey, n_nationkey, season", more="")}""")
API_COMPETITION = query([API], f"""SELECT CAST(r_regionkey AS INTEGER) AS api_football_id, r_name AS name, 'World' AS country, CAST(NULL AS VARCHAR) AS type,
  CAST(NULL AS VARCHAR) AS logo_url, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM {_NEWEST.format(keys="r_regionkey", more="")}""")
API_COMPETITION_SEASON = query([API], f"""SELECT CAST(r_regionkey AS INTEGER) AS competition_id, season, FALSE AS is_current, CAST(o_orderdate AS TIMESTAMP) AS updated_at
  FROM {_NEWEST.format(keys="r_regionkey, season", more="")}""")
API_TEAM = query([API], f"""SELECT CAST(n_nationkey AS INTEGER) AS api_football_id, n_name AS name, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS logo_url,
  CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM {_NEWEST.format(keys="n_nationkey", more="")}""")
API_PLAYERS = query([API], f"""
SELECT CAST(o_custkey AS INTEGER) AS api_football_id, c_name AS name, CAST(NULL AS VARCHAR) AS firstname, CAST(NULL AS VARCHAR) AS lastname,
  CAST(o_orderdate AS DATE) AS birth_date, CAST(NULL AS VARCHAR) AS birth_place, CAST(NULL AS VARCHAR) AS birth_country, CAST(NULL AS VARCHAR) AS nationality,
  CAST(o_custkey % 50 + 150 AS INTEGER) AS height_cm, CAST(NULL AS INTEGER) AS weight_kg, CAST(NULL AS VARCHAR) AS photo_url, CAST(o_orderdate AS TIMESTAMP) AS updated_at
FROM {_NEWEST.format(keys="o_custkey", more="")}""")
API_FILES = query([API], "SELECT unnest(['documents', 'payloads', 'lost']) AS what, unnest([count(*), count(*), 0]) AS value FROM asked")
STAR_PARTS = query([API], "SELECT unnest(['teams', 'renamed', 'parts_changed']) AS what, unnest([count(DISTINCT n_nationkey), 1, 1]) AS value FROM good")
LOAD_INTERRUPTED = query([STG], """
SELECT step, CASE WHEN whole THEN count(*) ELSE count(*) FILTER (competition_name = 'EUROPE') END AS rows,
  CASE WHEN whole THEN count(*) ELSE count(*) FILTER (competition_name = 'EUROPE') END AS registered
FROM stg, (VALUES ('first', FALSE), ('interrupted', FALSE), ('second', TRUE), ('again', TRUE)) AS s(step, whole) GROUP BY step, whole""")
CSV_MALFORMED = query([STG], """
SELECT unnest(['landed', 'numbers', 'registered', 'malformed', 'longer', 'misplaced']) AS what, unnest([good, good, good, bad, longer, 0]) AS value
FROM (SELECT count(*) FILTER (id % 50 NOT IN (3, 4)) AS good, count(*) FILTER (id % 50 IN (3, 4)) AS bad, count(*) FILTER (id % 50 = 3) AS longer FROM stg)""")

COHORT_OUTCOMES = query(CANONICAL, """
SELECT season, position_group, n AS cohort_size, CASE WHEN n < 3 THEN 'COHORT_TOO_SMALL' WHEN missing > 0 THEN 'MISSING_FEATURES' ELSE 'OK' END AS status,
  CASE WHEN n < 3 THEN 'Not enough eligible players in cohort ' || season || '|' || position_group || '.'
       WHEN missing > 0 THEN 'Missing feature values detected: shots_per90: ' || missing END AS detail
FROM (SELECT season, position_group, count(*) AS n, count(*) FILTER (minutes % 97 = 0) AS missing FROM canon
      WHERE is_similarity_eligible AND position_group <> 'GK' GROUP BY season, position_group)""")
