"""Mix sources to target weights by pivotal dependent rounding.

Every document starts with the fractional number of copies that its source needs. The whole part is
certain. The fractions are rounded in pairs: mass moves at random between two documents until one of
them is integral, so that the words both take stay the same and every fraction keeps its expectation.
What is left of a block, one fractional document, goes up a reduction tree with the rest of other
blocks until one document per source is left, which goes to the nearer whole number; the words that this
adds or drops, at most half a document, are made good by documents of the same last block, singly or in pairs. All draws are hashes of document ids: reruns agree.

A block holds about ``block`` documents and is rounded by SQL array functions; only (id, size, source)
leaves the text scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from stintworks.llm.common import WORD, text_of
from stintworks.workspace import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
BLOCK = 64
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, target``: one row per source, NULL source last.

    The sources share the sum of all sizes by weight. A source above ``most`` times its size stops
    there and the excess is shared again. In order of ``size / weight`` the sources that stop come
    first, so one pass over the sources (not over documents) finds where stopping ends.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    ranked = ranked.withColumn("stops_at", F.col("limit") / F.col("weight"))
    order = W.orderBy("stops_at", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything))
    left = F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(onward))
    # The first source that does not stop sets the level of all that do not stop.
    ranked = ranked.withColumn("final", F.min(F.when(F.col("level") <= F.col("stops_at"), F.struct("stops_at", "level"))).over(everything))
    free = F.col("final").isNotNull() & (F.col("stops_at") >= F.col("final.stops_at"))
    target = F.when(free, F.least("limit", F.col("weight") * F.col("final.level"))).otherwise(F.col("limit"))
    return ranked.select("source", "source_size", target.alias("target"))


def _round_block(seed: int) -> str:
    """SQL for one block: fold its documents, carrying the one that is still fractional.

    With sizes a, b and fractions p, q the carried document gains ``up / a`` while the other loses
    ``up / b``, or the other way round with ``down``; the odds keep both expectations.
    """
    unit = "named_struct('id', CAST(NULL AS BIGINT), 'size', CAST(0 AS BIGINT), 'p', CAST(0 AS DOUBLE), 'tie', CAST(0 AS BIGINT))"
    draw = f"(CAST(shiftrightunsigned(xxhash64({seed}, acc.rest.tie, x.tie), 11) AS DOUBLE) / 9007199254740992D)"
    step = f"""
      transform(array(named_struct(
        'up', least((1 - acc.rest.p) * acc.rest.size, x.p * x.size),
        'down', least(acc.rest.p * acc.rest.size, (1 - x.p) * x.size))), m ->
        transform(array(IF({draw} * (m.up + m.down) < m.down, m.up, -m.down)), d ->
          named_struct(
            'a', named_struct('id', acc.rest.id, 'size', acc.rest.size, 'p', acc.rest.p + d / acc.rest.size, 'tie', acc.rest.tie),
            'b', named_struct('id', x.id, 'size', x.size, 'p', x.p - d / x.size, 'tie', x.tie)))[0])[0]"""
    whole = f"(s.a.p <= {_EPS} OR s.a.p >= 1 - {_EPS})"
    return f"""
      aggregate(units, named_struct('rest', {unit}, 'done', CAST(array() AS ARRAY<STRUCT<id: BIGINT, tie: BIGINT, size: BIGINT, one: BOOLEAN>>)),
        (acc, x) -> IF(acc.rest.size = 0, named_struct('rest', x, 'done', acc.done),
          transform(array({step}), s -> named_struct(
            'rest', IF({whole}, s.b, s.a),
            'done', concat(acc.done, array(IF({whole},
                named_struct('id', s.a.id, 'tie', s.a.tie, 'size', s.a.size, 'one', s.a.p > 0.5), named_struct('id', s.b.id, 'tie', s.b.tie, 'size', s.b.size, 'one', s.b.p > 0.5))))))[0]))"""


def _round_root() -> str:
    """SQL for the block of a source that is its last: round the document that is left to the nearer whole
    number, then turn over one or two rounded documents of the block at a time, those that leave the
    smallest error in words, as long as the error shrinks. A block has as many chances as documents."""
    left = "IF(r.rest.p >= 0.5, 1 - r.rest.p, -r.rest.p) * r.rest.size"
    last = "filter(array(named_struct('id', r.rest.id, 'tie', r.rest.tie, 'size', r.rest.size, 'one', r.rest.p >= 0.5)), d -> d.size > 0)"
    turn, other = ("IF({0}.one, -{0}.size, {0}.size)".format(name) for name in "de")
    both = f"{turn} + IF(i = j, 0, {other})"
    best = f"""array_min(transform(acc.done, (d, i) -> array_min(transform(acc.done, (e, j) ->
          named_struct('error', abs(acc.error + {both}), 'i', i, 'j', j, 'turn', {both})))))"""
    return f"""
      aggregate(sequence(0, size(r.done)), named_struct('error', {left}, 'done', concat(r.done, {last})),
        (acc, k) -> transform(array({best}), b -> IF(b.error < abs(acc.error) - 1e-6, named_struct(
          'error', acc.error + b.turn,
          'done', transform(acc.done, (d, i) -> named_struct('id', d.id, 'tie', d.tie, 'size', d.size, 'one', IF(i = b.i OR i = b.j, NOT d.one, d.one)))),
          acc))[0]).done"""


def pivotal(units: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Round ``p`` of ``units`` (``source, id, tie, size > 0, 0 < p < 1``): ``source, id, tie, one`` for every unit.

    Blocks are dealt by hash, so a source with most documents has as many tasks as it has blocks.
    """
    done = None
    level = 0
    units = materialize(units, "mix-units")
    while True:
        per_source = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        largest = per_source.agg(F.max("n")).first()[0]
        if largest is None:
            break
        last = largest <= block
        # So many blocks that the last one of a source, made of what the others leave, has documents to choose from.
        blocks = F.ceil(F.when(F.col("n") <= block * block, F.least(F.lit(block), F.col("n") / 4)).otherwise(F.col("n") / block)).cast("long")
        dealt = units.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        waiting = dealt.filter(F.lit(not last) & (F.col("n") <= block)).select("source", "id", "tie", "size", "p")
        dealt = dealt.filter(F.lit(last) | (F.col("n") > block)).withColumn("block", F.when(F.lit(last), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(seed + level), "tie"), blocks)))
        rounded = (
            dealt.groupBy("source", "block")
            # Neighbours in size make the smallest moves.
            .agg(F.array_sort(F.collect_list(F.struct("size", "id", "tie", "p"))).alias("sorted"))
            .withColumn("units", F.expr("transform(sorted, u -> named_struct('id', u.id, 'size', u.size, 'p', u.p, 'tie', u.tie))"))
            .select("source", F.expr(_round_block(seed + level)).alias("r"))
        )
        if last:
            rounded = rounded.select("source", F.expr(_round_root()).alias("done"))
            step = rounded.select("source", F.explode("done").alias("d")).select("source", "d.id", "d.tie", "d.one")
            done = step if done is None else done.unionByName(step)
            break
        rounded = materialize(rounded, f"mix-level-{level}")
        step = rounded.select("source", F.explode("r.done").alias("d")).select("source", "d.id", "d.tie", "d.one")
        done = step if done is None else done.unionByName(step)
        rest = rounded.select("source", "r.rest.*").filter("size > 0")
        settled = f"p <= {_EPS} OR p >= 1 - {_EPS}"
        done = done.unionByName(rest.filter(settled).select("source", "id", "tie", (F.col("p") > 0.5).alias("one")))
        rest = rest.filter(f"NOT ({settled})").select("source", "id", "tie", "size", "p")
        units, level = materialize(rest.unionByName(waiting), "mix-units"), level + 1
    if done is None:
        done = units.select("source", "id", "tie", F.lit(False).alias("one"))
    return done


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST_COPIES,
    block: int = BLOCK,
    seed: int = 7,
) -> DataFrame:
    """How often the mix takes every document.

    Result: ``doc_id, size, source, source_size, target, copies, taken`` with one row per input row.
    Size is the number of words (NULL text: none); documents without words are taken once if their
    source takes at least its own size, else not, which changes no sum. NULL source is a source.
    Rows that repeat id, text and source each count. No document exceeds ``most`` copies. An empty
    table gives an empty result.
    """
    words = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        words.alias("size"),
    )
    # Rows that agree in all three share a tie number; the count tells them apart.
    rows = materialize(
        rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("repeats")), "mix-sizes"
    )
    sizes = rows.select("source", (F.col("size") * F.col("repeats")).alias("size"))
    goals = materialize(targets(sizes, weights, most), "mix-targets")
    each = rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("no"))
    each = each.withColumn("tie", F.xxhash64("doc_id", "source", "size", "no"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = each.join(goals.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    wanted = wanted.withColumn("share", F.least(share, F.lit(float(most))))
    near = F.round("share")
    whole = F.when(F.abs(F.col("share") - near) <= _EPS, near).otherwise(F.floor("share")).cast("long")
    wanted = materialize(wanted.withColumn("whole", whole).withColumn("p", F.greatest(F.col("share") - whole, F.lit(0.0))), "mix-wanted")
    open_units = wanted.filter((F.col("size") > 0) & (F.col("p") > _EPS))
    chosen = pivotal(open_units.select("source", F.col("doc_id").alias("id"), "tie", "size", "p"), block, seed).filter("one")
    copies = F.col("whole") + F.when(F.col("picked"), 1).otherwise(0)
    chosen = chosen.select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.lit(True).alias("picked"))
    return (
        wanted.join(chosen, (F.col("tie") == F.col("__tie")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as the mix takes them: each as many times as its copies say, with all columns."""
    plan = mix(docs, id_col, text_col, source_col, **options).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")
    )
    plan = plan.groupBy("__id", "__source", "__size").agg(F.sort_array(F.collect_list("__copies")).alias("__each"))
    rows = docs.withColumn("__words", F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"))
    same = (
        rows[f"`{id_col}`"].cast("long").eqNullSafe(plan["__id"])
        & rows[f"`{source_col}`"].eqNullSafe(plan["__source"])
        & (rows["__words"] == plan["__size"])
    )
    joined = rows.join(plan, same)
    # Rows that agree in id, source and size share their copies out in any order.
    nth = F.row_number().over(W.partitionBy(f"`{id_col}`", f"`{source_col}`", "__words").orderBy(text_of(text_col)))
    repeated = F.size("__each") > 1
    joined = joined.withColumn("__nth", nth) if plan.filter("size(__each) > 1").limit(1).count() else joined.withColumn("__nth", F.lit(1))
    count = F.when(repeated, F.element_at("__each", F.col("__nth"))).otherwise(F.element_at("__each", 1)).cast("int")
    copies = F.explode(F.sequence(F.lit(1), count))
    return joined.filter(count > 0).select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias("__copy")).drop("__copy")
