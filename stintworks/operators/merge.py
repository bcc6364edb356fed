"""Keyed merges of one table into another, as new versions of the target."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the greatest ``order`` per key, by one partial aggregate.

    NULL keys never match each other: rows without a complete key all stay.
    """
    rest = [c for c in rows.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("latest")
    keyed = rows.filter(~_keyless(keys)).groupBy(*keys).agg(latest).select(*keys, "latest.*").select(*rows.columns)
    return keyed.unionByName(rows.filter(_keyless(keys)))


def _keyless(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def _spread(rows: DataFrame, keys: Sequence[str], name: str) -> Column:
    return F.when(_keyless(keys), F.xxhash64(*rows.columns)).otherwise(F.lit(0)).alias(name)


def merge_by_key(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str],
    order: Sequence[str] | None = None,
    mode: str = "update",
) -> DataFrame:
    """Insert new keys; for known keys replace ``update_columns`` only.

    ``mode='ignore'`` leaves known keys as they are. With ``order`` the last update per key wins;
    without it the updates must already be unique. Columns the updates do not have stay NULL on
    insert. NULL keys never match, as under a unique constraint.
    """
    if mode not in ("update", "ignore"):
        raise ValueError("mode must be 'update' or 'ignore'")
    if order is not None:
        updates = last_per_key(updates, keys, order)
    carried = [c for c in updates.columns if c in target.columns]
    if mode == "ignore":
        fresh = updates.select(*carried)
        known = target.select(*keys).filter(~_keyless(keys))
        # Rows without a key match nothing and need not crowd the join.
        fresh = fresh.filter(~_keyless(keys)).join(known, list(keys), "left_anti").unionByName(fresh.filter(_keyless(keys)))
        return target.unionByName(fresh, allowMissingColumns=True).select(*target.columns)

    # Rows without a key match nothing; a hash of the row keeps them from crowding one join task.
    old = target.select(*[F.col(c).alias(f"old_{c}") for c in target.columns], _spread(target, keys, "old_spread"), F.lit(True).alias("is_old"))
    new = updates.select(*[F.col(c).alias(f"new_{c}") for c in carried], _spread(updates, keys, "new_spread"), F.lit(True).alias("is_new"))
    on = [F.col(f"old_{k}") == F.col(f"new_{k}") for k in keys] + [F.col("old_spread") == F.col("new_spread")]
    merged = old.join(new, on, "full_outer")

    def column(name: str) -> Column:
        if name not in carried:
            return F.col(f"old_{name}")
        if name in keys:
            return F.coalesce(F.col(f"old_{name}"), F.col(f"new_{name}"))
        if name in update_columns:
            return F.when(F.col("is_new"), F.col(f"new_{name}")).otherwise(F.col(f"old_{name}"))
        return F.when(F.col("is_old"), F.col(f"old_{name}")).otherwise(F.col(f"new_{name}"))

    return merged.select(*[column(c).alias(c) for c in target.columns])
