"""A canonical layer and its cohort moments that new batches are folded into.

Kept are one partial fold per entity and season, and whole-number sums per cohort. A new batch is folded by itself and
merged into the parts its keys fall in; the stints of earlier batches are not read again. Cohort sums change by those
parts' sums after the merge less their sums before it, which is exact. All tables are published at once, with the batches
they hold, so a run that is lost or repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stintworks.operators.canonical import LOAD_ORDER, finished_fold, merge_folds, partial_fold
from stintworks.operators.cohorts import (
    COHORT, merge_sums, moment_sums, moments_of_sums, negated_sums, similarity_population,
)
from stintworks.plans.store import BUCKETS, TableStore, join_changes
from stintworks.schemas import STAGING
from stintworks.workspace import materialize, scope, shuffles_end

FOLDS, SUMS, FOLDED = "folds", "cohort_sums", "folded_batches"


@dataclass(frozen=True)
class RunningLayer:
    """The layer kept in ``store``. Its settings must stay the same between batches.

    Stints are folded under the keys they come with. When identity rules change the keys of earlier stints, or a batch is
    to be taken back, fold the remaining batches into a new store: greatest values and name lists cannot be subtracted.
    """

    store: TableStore
    key: str = "canonical_player_key"
    name: str = "canonical_player_name"
    tie_break: Sequence[str] = LOAD_ORDER
    cohort_cols: Sequence[str] = COHORT
    buckets: int = BUCKETS

    def add(self, stints: DataFrame) -> int:
        """Fold in those batches of ``stints`` that are not in yet; the version that holds them."""
        # What leads to the published parts goes when they are there.
        with scope(self.store.spark), shuffles_end(self.store.spark):
            since = self.store.version()
            known = self.store.manifest(since).get(FOLDED, {})
            batches = [r[0] for r in stints.select("batch_id").distinct().collect()]  # one per file landed
            if None in batches:
                raise ValueError("stints without a batch cannot be told apart from stints that are in")
            fresh = [b for b in batches if str(b) not in known]
            if not fresh:
                return since
            new = partial_fold(stints.filter(F.col("batch_id").isin(fresh)), self.key, self.name, self.tie_break)
            new = materialize(new, "partial-folds")
            touched = [r[0] for r in new.select(self._part()).distinct().collect()]  # at most seasons times buckets
            before = self.store.read(FOLDS, self._fold_schema(), touched, since)
            folds = self.store.stage(FOLDS, merge_folds(before.unionByName(new), self.key), self._part())
            after = self.store.staged(folds, FOLDS, self._fold_schema())
            change = self._sums(after).unionByName(negated_sums(self._sums(before), self.cohort_cols))
            totals = merge_sums(self.store.read(SUMS, change.schema, version=since).unionByName(change), self.cohort_cols)
            sums = self.store.stage(SUMS, totals, F.lit("all"))  # one row per cohort
            marks = self.store.spark.createDataFrame([(b,) for b in fresh], "batch_id long")
            held = self.store.stage(FOLDED, marks, F.col("batch_id"))
            return self.store.publish(join_changes(folds, sums, held), since)

    def canonical(self) -> DataFrame:
        """The canonical layer of all batches, as ``canonical`` gives it."""
        return finished_fold(self.store.read(FOLDS, self._fold_schema()), self.key)

    def moments(self) -> DataFrame:
        """The cohort moments of all batches, as ``moments`` gives them."""
        empty = self.store.spark.createDataFrame([], self._fold_schema())
        sums = self.store.read(SUMS, self._sums(empty).schema).filter("cohort_size > 0")
        return moments_of_sums(sums, self.cohort_cols)

    def _part(self) -> Column:
        """A season's rows by hash of the key, so that a batch touches its own season."""
        season = F.coalesce(F.col("season").cast("string"), F.lit("none"))
        return F.concat_ws("-", season, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("string"))

    def _sums(self, folds: DataFrame) -> DataFrame:
        return moment_sums(similarity_population(finished_fold(folds, self.key)), self.cohort_cols)

    def _fold_schema(self) -> T.StructType:
        rows = self.store.spark.createDataFrame([], STAGING)
        for column in (self.key, self.name):
            if column not in rows.columns:
                rows = rows.withColumn(column, F.lit(None).cast("string"))
        return partial_fold(rows, self.key, self.name, self.tie_break).schema
