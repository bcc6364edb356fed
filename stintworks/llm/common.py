"""Column helpers and joins that several training-data operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str) -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def lower_az(column: Column) -> Column:
    """Lower-case A-Z only. Texts without other characters take the shorter way."""
    only_ascii = F.octet_length(column) == F.char_length(column)
    return F.when(only_ascii, F.lower(column)).otherwise(
        F.translate(column, string.ascii_uppercase, string.ascii_lowercase)
    )


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot_share: int = 1000) -> DataFrame:
    """Give every row the columns of its group (inner join on NULL-free ``keys``; one group row per key).

    A group with at least one ``hot_share``-th of all rows would land in one task. There are at most
    ``hot_share`` such groups, so these few are broadcast; the others meet in a shuffle join.
    """
    floor = rows.count() / hot_share
    hot = groups.filter(F.col(size) >= F.lit(floor))
    cold = groups.filter(F.col(size) < F.lit(floor))
    few = F.broadcast(hot)
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
