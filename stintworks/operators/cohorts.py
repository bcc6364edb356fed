"""Comparison cohorts: population, exact moments and z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stintworks.schemas import FEATURES, ROLE_FEATURES

COHORT = ("season", "position_group")
# Rates carry four decimals, so scaled by this they are whole numbers and their sums are exact.
UNIT = 10000


def similarity_population(canonical: DataFrame) -> DataFrame:
    return canonical.filter(F.col("is_similarity_eligible") & (F.col("position_group") != "GK"))


def _whole(feature: str) -> Column:
    return (F.col(feature) * UNIT).cast("long")


def moments(
    population: DataFrame,
    cohort_cols: Sequence[str] = COHORT,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """One row per cohort: size and, per feature, missing count, mean and population deviation.

    Sums are taken over whole numbers, so the result does not depend on row order or partitioning
    and a constant feature is recognised exactly; its deviation becomes one unit.
    """
    return moments_of_sums(moment_sums(population, cohort_cols, features), cohort_cols, features)


def moment_sums(population: DataFrame, cohort_cols: Sequence[str] = COHORT, features: Sequence[str] = FEATURES) -> DataFrame:
    """Size and, per feature, count, sum and sum of squares of each cohort, in whole numbers that add and subtract exactly."""
    sums = []
    for f in features:
        x = _whole(f)
        sums += [
            F.count(x).alias(f"n_{f}"),
            F.sum(x).alias(f"s1_{f}"),
            F.sum(x.cast("decimal(18,0)") * x.cast("decimal(18,0)")).alias(f"s2_{f}"),
        ]
    return population.groupBy(*cohort_cols).agg(F.count(F.lit(1)).alias("cohort_size"), *sums)


def negated_sums(sums: DataFrame, cohort_cols: Sequence[str] = COHORT) -> DataFrame:
    """Sums that take their rows away when they are merged."""
    return sums.select(*cohort_cols, *[(-F.col(c)).alias(c) for c in sums.columns if c not in cohort_cols])


def merge_sums(sums: DataFrame, cohort_cols: Sequence[str] = COHORT, features: Sequence[str] = FEATURES) -> DataFrame:
    """Sums of the same cohort as one. A cohort that lost all its rows stays with size 0."""
    merged = [F.sum("cohort_size").alias("cohort_size")]
    for f in features:
        n = F.sum(f"n_{f}")
        # Without values there is no sum, as in a first pass.
        merged += [n.alias(f"n_{f}"), *[F.when(n != 0, F.sum(f"{s}_{f}")).alias(f"{s}_{f}") for s in ("s1", "s2")]]
    return sums.groupBy(*cohort_cols).agg(*merged)


def moments_of_sums(totals: DataFrame, cohort_cols: Sequence[str] = COHORT, features: Sequence[str] = FEATURES) -> DataFrame:
    """Moments as ``moments`` gives them, from sums."""
    wide = "decimal(38,0)"
    columns = []
    for f in features:
        n, s1, s2 = F.col(f"n_{f}"), F.col(f"s1_{f}"), F.col(f"s2_{f}")
        spread = n.cast("decimal(11,0)") * s2.cast("decimal(26,0)") - (
            s1.cast("decimal(19,0)") * s1.cast("decimal(19,0)")
        ).cast(wide)
        size = F.nullif(n, F.lit(0)).cast("double")
        columns += [
            (F.col("cohort_size") - n).alias(f"missing_{f}"),
            (s1.cast("double") / size).alias(f"mean_{f}"),
            F.when(spread == 0, F.lit(1.0) * UNIT)
            .otherwise(F.sqrt(spread.cast("double")) / size)
            .alias(f"std_{f}"),
        ]
    return totals.select(*cohort_cols, "cohort_size", *columns)


def missing_total(features: Sequence[str] = FEATURES) -> Column:
    return sum((F.col(f"missing_{f}") for f in features), F.lit(0))


def moments_long(wide: DataFrame, cohort_cols: Sequence[str] = COHORT, features: Sequence[str] = FEATURES) -> DataFrame:
    """Moments with one row per cohort and feature, in feature units."""
    entry = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"missing_{f}").alias("missing"),
            (F.col(f"mean_{f}") / UNIT).alias("mean"),
            (F.col(f"std_{f}") / UNIT).alias("std"),
        )
        for f in features
    ]
    return wide.select(*cohort_cols, "cohort_size", F.explode(F.array(*entry)).alias("m")).select(
        *cohort_cols, "cohort_size", "m.*"
    )


def zscores(
    population: DataFrame,
    wide: DataFrame,
    cohort_cols: Sequence[str] = COHORT,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Population plus ``cohort_size`` and ``z``, the standardised features in order.

    The moments hold one row per cohort: read from a stored table Spark broadcasts them, so the
    population is not shuffled onto its few cohorts.
    """
    z = [(_whole(f).cast("double") - F.col(f"mean_{f}")) / F.col(f"std_{f}") for f in features]
    kept = [population[c] for c in population.columns]
    return population.join(wide, list(cohort_cols)).select(*kept, "cohort_size", F.array(*z).alias("z"))


def cohort_id(cohort_cols: Sequence[str] = COHORT) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cohort_cols])


def role_mask(group: Column, features: Sequence[str] = FEATURES) -> Column:
    """0/1 per feature for the position group's role set; NULL where the group has none."""
    masks = [
        F.when(group == name, F.array(*[F.lit(float(f in chosen)) for f in features]))
        for name, chosen in ROLE_FEATURES.items()
    ]
    return F.coalesce(*masks)
