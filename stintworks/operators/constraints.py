"""Table constraints as frames of violating rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F


def null_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.filter(reduce(or_, [F.col(c).isNull() for c in columns]))


def unique_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by several rows; as under a unique constraint, rows with a NULL key never clash."""
    keyed = rows.dropna(subset=list(keys))
    return keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def foreign_key_violations(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows whose key has no parent; ``on`` maps child to parent columns. NULL keys pass."""
    known = parent.select(*[F.col(p).alias(c) for c, p in on.items()])
    return child.dropna(subset=list(on)).join(known, list(on), "left_anti").select(*child.columns)


def length_violations(rows: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    return rows.filter(reduce(or_, [F.length(c) > n for c, n in limits.items()]))


def cascade(child: DataFrame, surviving: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows left after their parents were reduced to ``surviving``. Rows without a key have no parent and stay."""
    known = surviving.select(*[F.col(p).alias(c) for c, p in on.items()])
    keyless = reduce(or_, [F.col(c).isNull() for c in on])
    kept = child.filter(~keyless).join(known, list(on), "left_semi").select(*child.columns)
    return kept.unionByName(child.filter(keyless))
