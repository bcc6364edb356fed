"""Column builders for rates, groups and quality bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Raw position texts per comparison group, and the role family of each group.
POSITION_GROUPS = {
    "FW_MF": ["MF,FW", "FW,MF"],
    "DF_MF": ["DF,MF", "MF,DF"],
    "DF_FW": ["DF,FW", "FW,DF"],
    "FW": ["FW"],
    "MF": ["MF"],
    "DF": ["DF"],
    "GK": ["GK"],
}
ROLE_FAMILIES = {
    "GK": "GOALKEEPER",
    "DF": "DEFENDER",
    "DF_MF": "DEFENSIVE_HYBRID",
    "MF": "MIDFIELDER",
    "FW_MF": "ATTACKING_HYBRID",
    "FW": "FORWARD",
    "DF_FW": "OTHER_HYBRID",
}
UNKNOWN = "UNKNOWN"
MIN_MINUTES = 900
HIGH_MINUTES = 1800

# Wide enough for any long, narrow enough that a division keeps 13 fraction digits.
_WHOLE = "decimal(19,0)"


def ratio(numerator: Column, denominator: Column, scale: int, factor: int = 1) -> Column:
    """``round(numerator * factor / denominator, scale)``; a zero denominator gives NULL."""
    top = numerator.cast(_WHOLE) * F.lit(factor).cast("decimal(3,0)")
    return F.round(top / F.nullif(denominator, F.lit(0)).cast("decimal(12,0)"), scale)


def per90(measure: str, minutes: str = "minutes", scale: int = 4, null_as_zero: bool = True) -> Column:
    value = F.col(measure)
    if null_as_zero:
        value = F.coalesce(value, F.lit(0))
    return ratio(value, F.col(minutes), scale, 90)


def pct(part: str, whole: str) -> Column:
    return ratio(F.col(part), F.col(whole), 2, 100)


def _mapped(value: Column, cases: dict[str, list[str]]) -> Column:
    matches = [F.when(value.isin(texts), F.lit(name)) for name, texts in cases.items()]
    return F.coalesce(*matches, F.lit(UNKNOWN))


def position_group(raw: Column) -> Column:
    return _mapped(raw, POSITION_GROUPS)


def role_family(group: Column) -> Column:
    return _mapped(group, {family: [g] for g, family in ROLE_FAMILIES.items()})


def sample_quality(minutes: Column) -> Column:
    played = F.coalesce(minutes, F.lit(0))
    return (
        F.when(played >= HIGH_MINUTES, "HIGH").when(played >= MIN_MINUTES, "MEDIUM").otherwise("LOW")
    )


def stint_eligible(minutes: Column, group: Column) -> Column:
    """Rule of the stint-level base: keepers count, unmapped positions do not."""
    return F.coalesce((minutes >= MIN_MINUTES) & (group != UNKNOWN), F.lit(False))


def canonical_eligible(minutes: Column, raw_position: Column) -> Column:
    """Rule of the canonical layer: everyone but keepers; a NULL position is not eligible."""
    return F.coalesce((minutes >= MIN_MINUTES) & (raw_position != "GK"), F.lit(False))
