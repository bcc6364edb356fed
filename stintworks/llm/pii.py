"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Patterns propose candidates. Regex, gazetteer, context, boundary and shape labelers vote for, against or not at
all. The votes of a kind form at most ``3 ** 5`` patterns; their counts are all that
expectation-maximisation needs to estimate how reliable each labeler is and how likely each pattern is
personal data. These likelihoods train the final classifier, naive Bayes over discrete traits of a span.

The base kinds (email, ip, card, phone) are defined by pattern and check; their spans always stay. Spans
of the other kinds stay if the classifier says so. The whole scan is DataFrame code; only the two
bounded count tables come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from stintworks.llm.common import text_of
from stintworks.workspace import materialize

BASE = ("email", "ip", "card", "phone")

# Given names, letters that close a host name, words near personal data.
GIVEN_NAMES = (
    "Alice Anna Antonio Carlos Carmen Charles Claire David Elena Elizabeth Emma Francisco Hans Isabel Jacques James Jean Jennifer"
    " Jessica Johann John Jose Juan Julia Karl Klaus Laura Linda Louis Lucia Manuel Maria Marie Mary Michael Michel Miguel Nicolas"
    " Olivia Patricia Paul Pedro Peter Petra Pierre Richard Robert Sabine Sarah Sofia Stefan Susan Thomas Ursula William Wolfgang"
).split()
TOP_DOMAINS = "com org net edu gov io info biz de fr es uk at ch it eu us".split()
CONTEXT = (
    "mail e-mail contact write kontakt correo courriel call phone tel telephone mobile fax telefon ip host server address adresse"
    " card credit visa mastercard karte carte tarjeta ssn social security iban account konto compte cuenta mr mrs ms dr name author"
).split()

# Java patterns. A possessive quantifier or a look-behind keeps a search linear where the plain pattern would
# start again at every character of a long run; what it finds is the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mail_text": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10}+",
    "person": r"(?<!\p{L})(?:" + "|".join(GIVEN_NAMES) + r") \p{Lu}\p{L}{1,30}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# A text without this has no match; NULL: look at every text.
NEEDED = {"email": "@", "phone": "+", "ssn": "-", "mail_text": "at"}
KINDS = tuple(PATTERNS)
# Matches of a text that are listed together before lists are joined.
_LISTED = 256

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace(c.match, '[^0-9]', '')"
LABELERS = ("regex", "gazetteer", "context", "boundary", "shape")
ROUNDS = 30


def _cases(cases: dict[str, str], other: str) -> str:
    return "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


def _vote(yes: str, no: str = "false") -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, spans``: per row an array of (kind, start, end, match, before, after), places in code points.

    Matches and the text between them alternate, so lengths give places without another search. ``before``
    and ``after`` are the neighbouring characters up to the next match of the kind.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if kind in NEEDED:
            found = F.when(F.contains("text", F.lit(NEEDED[kind])), found).otherwise(none)
        rows = rows.withColumn(f"found_{kind}", found)
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(f"gaps_{kind}", F.when(F.size(f"found_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))
    span = "STRUCT<kind: STRING, start: BIGINT, end: BIGINT, match: STRING, before: STRING, after: STRING>"
    parts = []
    for kind in KINDS:
        found, gaps = f"found_{kind}", f"gaps_{kind}"
        start = f"acc.at + char_length({gaps}[i])"
        # Places are running sums. Appending copies a list, so matches are listed by hundreds and the lists joined at the end.
        some = f"""
          aggregate(sequence(c, least(c + {_LISTED - 1}, size({found}) - 1)), named_struct('at', whole.at, 'out', CAST(array() AS ARRAY<{span}>)),
            (acc, i) -> named_struct(
              'at', {start} + char_length({found}[i]),
              'out', concat(acc.out, array(named_struct('kind', '{kind}', 'start', {start}, 'end', {start} + char_length({found}[i]),
                'match', {found}[i], 'before', right({gaps}[i], 40), 'after', left({gaps}[i + 1], 8))))))"""
        parts.append(f"""
          IF(size({found}) = 0, CAST(array() AS ARRAY<{span}>),
            aggregate(sequence(0, size({found}) - 1, {_LISTED}), named_struct('at', 0L, 'out', CAST(array() AS ARRAY<ARRAY<{span}>>)),
              (whole, c) -> transform(array({some}), x -> named_struct('at', x.at, 'out', concat(whole.out, array(x.out))))[0],
              whole -> flatten(whole.out)))""")
    return rows.select("doc_id", F.expr(f"concat({', '.join(parts)})").alias("spans"))


def _checked() -> str:
    """SQL: does a base span pass its check? Other kinds always do."""
    ip = rf"c.match RLIKE r'^{_OCTET}(?:\.{_OCTET}){{3}}$'"
    card = f"char_length({_DIGITS}) BETWEEN 16 AND 19 AND luhn_check({_DIGITS})"
    return _cases({"ip": ip, "card": card, "phone": f"char_length({_DIGITS}) BETWEEN 8 AND 15"}, "true")


def _votes() -> dict[str, str]:
    """SQL of each labeler's vote on a candidate ``c``: 1 for, -1 against, 0 abstains."""
    domains = "|".join(TOP_DOMAINS)
    words = "|".join(CONTEXT)
    regex = _cases(
        {
            "email": _vote(r"c.match RLIKE r'^[A-Za-z0-9][A-Za-z0-9._%+-]*+@'", "true"),
            "ssn": _vote(r"NOT c.match RLIKE r'^(?:000|666|9..)-|-00-|-0000$'", "true"),
            "iban": _vote("char_length(regexp_replace(c.match, ' ', '')) BETWEEN 15 AND 34", "true"),
        },
        "1",
    )
    gazetteer = _cases(
        {
            "email": _vote(rf"c.match RLIKE r'(?i)\.(?:{domains})$'"),
            "mail_text": _vote(rf"c.match RLIKE r'(?i)\b(?:{domains})$'", "true"),
            "card": _vote(f"{_DIGITS} RLIKE r'^[3-6]'", "true"),
            "ip": _vote("c.match RLIKE r'^(?:0|127|255)\\.'", "false").replace("THEN 1", "THEN -1"),
            "phone": _vote(r"c.match RLIKE r'^\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[1-6]|9[0-8])'"),
            "person": "1",
        },
        "0",
    )
    context = _vote(rf"c.before RLIKE r'(?i)(?<!\p{{L}})(?:{words})(?!\p{{L}})'")
    boundary = _vote(r"c.before RLIKE r'[\p{L}0-9]$' OR c.after RLIKE r'^[\p{L}0-9]'").replace("THEN 1", "THEN -1").replace("ELSE 0", "ELSE 1")
    shape = _cases(
        {k: _vote(f"{_DIGITS} RLIKE r'^([0-9])\\1*$'").replace("THEN 1", "THEN -1").replace("ELSE 0", "ELSE 1") for k in ("card", "phone", "ssn")}
        | {"person": _vote(r"c.after RLIKE r'^ \p{Lu}'"), "iban": _vote(r"c.match RLIKE r'[0-9]{6}'", r"c.match RLIKE r'^[A-Z0-9 ]*[A-Z]{6}'")},
        "0",
    )
    return dict(zip(LABELERS, (regex, gazetteer, context, boundary, shape)))


def _traits() -> dict[str, str]:
    """SQL of the discrete traits that the classifier reads."""
    neighbour = "CASE WHEN {0} = '' THEN 'none' WHEN {0} RLIKE r'\\p{{L}}' THEN 'letter' WHEN {0} RLIKE '[0-9]' THEN 'digit' WHEN {0} RLIKE r'\\s' THEN 'blank' ELSE 'mark' END"
    return {
        "length": "CAST(least(12, floor(log2(char_length(c.match) + 1) * 2)) AS STRING)",
        "before": neighbour.format("right(c.before, 1)"),
        "after": neighbour.format("left(c.after, 1)"),
        "digits": f"CAST(floor(4 * char_length({_DIGITS}) / char_length(c.match)) AS STRING)",
        "near": "CAST(c.before RLIKE r'[:(<]\\s*$' AS STRING)",
    }


def voted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` with the votes (as a string of digits 0 to 2) and traits of every checked span; no text is kept."""
    votes = " , ".join(f"CAST(1 + {sql} AS STRING)" for sql in _votes().values())
    traits = ", ".join(f"'{name}', {sql}" for name, sql in _traits().items())
    spans = f"""
      transform(filter(spans, c -> {_checked()}), c ->
        named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'votes', concat({votes}), 'traits', map({traits})))"""
    return candidates(docs, id_col, text_col).select("doc_id", F.expr(spans).alias("spans"))


def estimate(counts: dict[str, dict[str, int]], rounds: int = ROUNDS) -> dict[str, dict[str, float]]:
    """Per kind, the probability that each pattern of votes is personal data.

    Expectation-maximisation of a two-class model in which labelers vote independently given the truth.
    It starts from the majority, with more weight on labelers that vote at all.
    """
    result = {}
    for kind, patterns in counts.items():
        chance = {p: min(0.95, max(0.05, 0.6 + 0.15 * sum(int(v) - 1 for v in p))) for p in patterns}
        for _ in range(rounds):
            total = sum(patterns.values())
            true = sum(n * chance[p] for p, n in patterns.items())
            prior = (true + 1) / (total + 2)
            tables = []
            for j in range(len(LABELERS)):
                table = {}
                for vote in "012":
                    yes = sum(n * chance[p] for p, n in patterns.items() if p[j] == vote)
                    no = sum(n * (1 - chance[p]) for p, n in patterns.items() if p[j] == vote)
                    # Weak prior: a vote for is likelier on personal data, a vote against on other text.
                    lean = {"0": (0.5, 1.5), "1": (1.0, 1.0), "2": (1.5, 0.5)}[vote]
                    table[vote] = (yes + lean[0]) / (true + 3), (no + lean[1]) / (total - true + 3)
                tables.append(table)
            for p in patterns:
                odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, p))
                chance[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        result[kind] = chance
    return result


def train(found: DataFrame) -> tuple[dict, dict]:
    """(log odds of a kind, log odds of each trait value) of the final classifier, from ``voted`` rows.

    Both count tables are bounded: kinds times vote patterns, kinds times trait values.
    """
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    counts: dict[str, dict[str, int]] = {}
    for r in spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["kind"], {})[r["votes"]] = r["n"]
    if not counts:
        return {}, {}
    chance = estimate(counts)
    looked_up = F.create_map(*[F.lit(x) for kind, ps in chance.items() for p, c in ps.items() for x in (f"{kind} {p}", c)])
    soft = spans.withColumn("p", F.element_at(looked_up, F.concat_ws(" ", "kind", "votes")))
    sums = soft.select("kind", "p", F.explode("traits").alias("trait", "value")).groupBy("kind", "trait", "value").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")
    )
    mass = {k: (sum(n * chance[k][p] for p, n in ps.items()), sum(n * (1 - chance[k][p]) for p, n in ps.items())) for k, ps in counts.items()}
    prior = {k: math.log((yes + 1) / (no + 1)) for k, (yes, no) in mass.items()}
    traits = {
        (r["kind"], r["trait"], r["value"]): math.log((r["yes"] + 1) / (mass[r["kind"]][0] + 8)) - math.log((r["no"] + 1) / (mass[r["kind"]][1] + 8))
        for r in sums.collect()
    }
    return prior, traits


def classify(found: DataFrame, model: tuple[dict, dict]) -> DataFrame:
    """``doc_id, spans`` with ``probability`` and ``base``; in the order of kinds, then place. Weak spans of further kinds go."""
    prior, traits = model
    odds = F.create_map(*[F.lit(x) for k, v in prior.items() for x in (k, v)]) if prior else None
    weight = F.create_map(*[F.lit(x) for (k, t, v), w in traits.items() for x in (f"{k} {t} {v}", w)]) if traits else None
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def judged(s: Column) -> Column:
        score = F.lit(0.0)
        if odds is not None:
            each = F.transform(F.map_entries(s["traits"]), lambda e: F.coalesce(F.element_at(weight, F.concat_ws(" ", s["kind"], e["key"], e["value"])), F.lit(0.0)))
            score = F.coalesce(F.element_at(odds, s["kind"]), F.lit(0.0)) + F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
        return F.struct(
            F.element_at(order, s["kind"]).alias("place"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
            (1 / (1 + F.exp(-score))).alias("probability"),
            s["kind"].isin(*BASE).alias("base"),
        )

    spans = F.array_sort(F.filter(F.transform("spans", judged), lambda s: s["base"] | (s["probability"] >= 0.5)))
    return found.select("doc_id", spans.alias("spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` with one row per input row: spans of personal data as (kind, start, end, probability, base).

    Spans of one kind do not overlap; of different kinds they may. NULL text counts as empty and has none.
    Extra columns are not read; an empty table gives an empty result.
    """
    found = materialize(voted(docs, id_col, text_col), "pii-votes")
    return classify(found, train(found))


def summarize(found: DataFrame) -> DataFrame:
    """Counts, and the spans as text ``kind:start:end``; the base spans also as a digest."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
