"""Filtered, ordered listings of the canonical layer."""

from __future__ import annotations

import json
from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Explorer record, output name -> canonical column.
LISTED = {
    "canonical_player_key": "canonical_player_key",
    "name": "player_name",
    "club": "primary_squad_name",
    "competition": "primary_competition_name",
    "position": "position_raw",
    "position_group": "position_group",
    "age": "age",
    "minutes": "minutes",
    "goals": "goals",
    "assists": "assists",
    "stint_count": "stint_count",
    "similarity_eligible": "is_similarity_eligible",
    "sample_quality": "sample_quality",
}
MAX_LIMIT = 100
DEEP_OFFSET = 100_000
# Places that cut the rows in a round of the search for a deep page, and rows they are chosen from.
PIVOTS = 63
SAMPLE_ROWS = 2048


def predicates(
    *,
    search: str | None = None,
    competition: str | None = None,
    club: str | None = None,
    position_group: str | None = None,
    min_minutes: int | None = None,
    similarity_eligible: bool | None = None,
    literal_search: bool = False,
) -> Column:
    """Conjunction of the filters that were given; ``%`` and ``_`` in a search are wildcards."""
    conditions = []
    if search:
        text = search.strip()
        if literal_search:
            conditions.append(F.contains(F.lower("player_name"), F.lower(F.lit(text))))
        else:
            conditions.append(F.col("player_name").ilike(f"%{text}%"))
    if competition:
        conditions.append(F.lower("primary_competition_name") == F.lower(F.lit(competition.strip())))
    if club:
        conditions.append(F.lower("primary_squad_name") == F.lower(F.lit(club.strip())))
    if position_group:
        conditions.append(F.upper("position_group") == F.upper(F.lit(position_group.strip())))
    if min_minutes is not None:
        if min_minutes < 0:
            raise ValueError("min_minutes must be 0 or greater")
        conditions.append(F.col("minutes") >= min_minutes)
    if similarity_eligible is not None:
        conditions.append(F.col("is_similarity_eligible") == similarity_eligible)
    return reduce(and_, conditions, F.lit(True))


def explore(
    canonical: DataFrame, *, limit: int = 25, offset: int = 0, range_rows: int = DEEP_OFFSET, **filters
) -> tuple[DataFrame, DataFrame]:
    """``(total, page)``: a one-row count and the page by minutes, name and key.

    Offsets beyond ``range_rows`` first narrow the rows to a range of about that many around the page.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if offset < 0:
        raise ValueError("offset must be 0 or greater")
    matching = canonical.filter(predicates(**filters))
    total = matching.agg(F.count(F.lit(1)).alias("total"))
    order = [F.desc("minutes"), F.asc("player_name"), F.asc("canonical_player_key"), F.asc("season")]
    if offset > range_rows:
        matching, offset = _range_of_page(matching, offset, limit, range_rows)
    return total, records(matching.orderBy(*order).offset(offset).limit(limit))


def _range_of_page(rows: DataFrame, offset: int, limit: int, range_rows: int) -> tuple[DataFrame, int]:
    """Only the rows around a deep page, and the offset left within them.

    An ordinary offset gathers every skipped row in one task. Here ``PIVOTS`` places in page order, from a sample
    by hash, cut the rows into ranges, which are counted; the ranges that hold the page are cut again until they
    are small enough. At most some thousand sample rows and ``PIVOTS`` + 1 counts a round come to the driver, at any number of
    rows, and nothing is written or sorted but the last range.
    """
    # Page order as one value that compares like it: larger minutes first, rows without minutes last.
    place = F.struct(
        F.col("minutes").isNull().alias("o0"), (-F.col("minutes")).alias("o1"), F.col("player_name").alias("o2"),
        F.col("canonical_player_key").alias("o3"), F.col("season").alias("o4"),
    )
    kind = rows.select(place.alias("place")).schema["place"].dataType

    def literals(pivots: list) -> Column:
        """The pivots as one array literal, and so one expression however many they are."""
        listed = [{f"o{i}": v for i, v in enumerate(p) if v is not None} for p in pivots]
        return F.from_json(F.lit(json.dumps(listed)), T.ArrayType(kind))

    here, size, seed = rows, rows.count(), 0
    while size > range_rows:
        hashed = F.pmod(F.xxhash64(F.lit(seed), "canonical_player_key", "season"), F.lit(1 << 30))
        sample = here.filter(hashed < int(min(1.0, SAMPLE_ROWS / size) * (1 << 30))).select(place.alias("place"))
        found = [tuple(r["place"]) for r in sample.orderBy("place").limit(4 * SAMPLE_ROWS).collect()]
        pivots = list(dict.fromkeys(found[i * len(found) // (PIVOTS + 1)] for i in range(1, PIVOTS + 1))) if found else []
        if not pivots:
            break
        cuts = literals(pivots)
        bucket = F.size(F.filter(cuts, lambda cut: cut < place))
        counts = dict(here.groupBy(bucket.alias("bucket")).count().collect())
        ends = list(accumulate(counts.get(part, 0) for part in range(len(pivots) + 1)))
        holding = [p for p, end in enumerate(ends) if end > offset and end - counts.get(p, 0) < offset + limit]
        if not holding:
            return rows.filter(F.lit(False)), 0
        first, last = holding[0], holding[-1]
        skipped, kept = ends[first] - counts.get(first, 0), sum(counts.get(p, 0) for p in holding)
        if kept >= size:  # rows that agree in every place cannot be told apart
            break
        if first > 0:
            here = here.filter(place > F.get(cuts, F.lit(first - 1)))
        if last < len(pivots):
            here = here.filter(place <= F.get(cuts, F.lit(last)))
        offset, size, seed = offset - skipped, kept, seed + 1
    return here, offset


def records(rows: DataFrame) -> DataFrame:
    renamed = rows.select(*[F.col(src).alias(out) for out, src in LISTED.items()])
    return renamed.withColumn("age", F.col("age").cast("int"))
