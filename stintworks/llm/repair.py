"""Conversation repair as a lightest derivation over a weighted hypergraph of repair items.

The turns of a repaired conversation read ``(s?(ua)+)?`` by the initials of their roles, an automaton with four
states. An item [i, k, p, q] says: turns i to k are repaired so that the automaton goes from p to q. Axioms are the
edits of one turn (keep, rerole, delete, with inserted turns before it); a deduction joins [i, k, p, r] and an axiom
or item [k, m, r, q]. Values are pairs (cost, audit), audits being the initials of the edits in order; a deduction adds
costs and appends audits, so no conclusion comes before its left antecedent, and Knuth's agenda pops items in order
of value, each once, until the goal is final.

No audit of a block of turns is the beginning of another (insertions come before a turn, never at the end of a block),
so blocks compare by the ranks of their audits: the same agenda runs over turns within a block and, with ranks for
audits, over blocks of a conversation, and over groups of those, each in tasks of bounded size. Choices then go down
again to the blocks. A conversation of any length is so repaired without one task holding it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stintworks.llm.common import text_of
from stintworks.workspace import materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
ROLES = {"u": "user", "a": "assistant"}
# States: nothing yet, after s, after u, after a. What each initial does to a state.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
STEPS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ACCEPTING = (START, AFTER_A)
LEGAL_PAIRS = ("su", "ua", "au")

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"

# A block holds so many distinct turns, or characters of text, at most (one longer turn is a block of its own).
BLOCK_TURNS = 256
BLOCK_CHARS = 8 << 20
# Turns in a range of the sorted conversations, and ranges at most.
TURNS_PER_PART = 20_000
MOST_PARTS = 4096

Edge = tuple[int, str]  # cost, audit (or rank as a one-character text)


@lru_cache(maxsize=4096)
def turn_edges(initial: str, fault: str) -> dict[int, dict[int, Edge]]:
    """Axioms of one turn: from state, to state, lightest (cost, audit). Up to two turns may be inserted before it."""
    edges: dict[int, dict[int, Edge]] = {}

    def offer(p: int, q: int, value: Edge) -> None:
        here = edges.setdefault(p, {})
        here[q] = min(here.get(q, value), value)

    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for p in range(STATES):
        for inserted, (at, cost) in enumerate(insertions(p)):
            before = INSERT * inserted
            offer(p, at, (cost + COSTS[DELETE], before + DELETE))
            if fault in (BLANK, DUPLICATE):
                continue
            if (at, initial) in STEPS:
                offer(p, STEPS[at, initial], (cost + COSTS[KEEP] + extra, before + KEEP))
            for role in ROLES:
                if (at, role) in STEPS:
                    offer(p, STEPS[at, role], (cost + COSTS[REROLE] + extra, before + REROLE))
    return edges


def next_inserted(state: int) -> str:
    """Initial of the only turn that can be inserted in a state."""
    return "a" if state == AFTER_U else "u"


def insertions(state: int) -> list[tuple[int, int]]:
    """State and cost after 0, 1 and 2 insertions; more lead back to one of these states."""
    out = [(state, 0)]
    for _ in range(2):
        at, cost = out[-1]
        out.append((STEPS[at, next_inserted(at)], cost + COSTS[INSERT]))
    return out


def lightest(units: list[dict[int, dict[int, Edge]]], start: int, goal: bool = False) -> dict[int, tuple[int, str, list[int]]]:
    """Knuth's agenda over ``units`` from state ``start``: final state -> (cost, audit, states before and after each unit).

    With ``goal``, stops when the goal is final and returns only the state that it was reached in.
    """
    n = len(units)
    final: dict[tuple[int, int], tuple[int, str, int]] = {}  # (unit, state) -> cost, audit, state before
    agenda: list[tuple[int, str, int, int, int]] = [(0, "", 0, start, -1)]
    while agenda:
        cost, audit, k, q, before = heapq.heappop(agenda)
        if k > n:
            goal_state = before
            break
        if (k, q) in final:
            continue
        final[k, q] = (cost, audit, before)
        if k == n:
            if goal:
                # The goal: turns may be inserted at the end of the whole conversation.
                for inserted, (at, extra) in enumerate(insertions(q)):
                    if at in ACCEPTING:
                        heapq.heappush(agenda, (cost + extra, audit + INSERT * inserted, n + 1, at, q))
            continue
        for r, (extra, mark) in units[k].get(q, {}).items():
            if (k + 1, r) not in final:
                heapq.heappush(agenda, (cost + extra, audit + mark, k + 1, r, q))
    else:
        goal_state = None
    out = {}
    for q in range(STATES):
        if (n, q) in final and (not goal or q == goal_state):
            path, state = [q], q
            for k in range(n, 0, -1):
                state = final[k, state][2]
                path.append(state)
            out[q] = (*final[n, q][:2], path[::-1])
    return out


def ranked(edges: list[dict]) -> list[dict]:
    """Edges of a node with the rank of their audits in place of these. Equal audits have equal ranks."""
    order = {audit: i for i, audit in enumerate(sorted({e["audit"] for e in edges}))}
    return [{**e, "rank": order[e["audit"]]} for e in edges]


def all_edges(units: list, first: bool, whole: bool = False) -> list[dict]:
    """Items over all ``units``, from every state; where a conversation begins, from the start alone; the one
    that the goal was reached by, where they are a whole conversation."""
    found = []
    for p in (START,) if first else range(STATES):
        for q, (cost, audit, path) in lightest(units, p, whole).items():
            found.append({"p": p, "q": q, "cost": cost, "audit": audit, "path": path})
    return ranked(found)


def faults(turns: DataFrame) -> DataFrame:
    """One row per distinct (conversation, turn, role, text) with ``copies`` and the ``fault`` of its first copy.

    Further copies are duplicates (or blank). The first row of a role and text in a conversation is no duplicate: equal
    texts are found by SHA-256. All joins are on keys that are unique on both sides, so no conversation is hot.
    Columns: ``c0, c`` (is the id known, the id), ``t0, t`` (likewise the turn), ``role, text, copies, fault``.
    """
    digest = F.sha2("text", 256)
    keyed = turns.select(
        F.col("conv_id").isNotNull().alias("c0"), F.coalesce("conv_id", F.lit(0)).alias("c"),
        F.col("turn").isNotNull().alias("t0"), F.coalesce("turn", F.lit(0)).alias("t"),
        "role", "text", "copies", digest.alias("digest"),
    )
    once = ["c0", "c", "t0", "t", "role", "digest"]
    rows = keyed.groupBy(*once).agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    known = F.min(F.when(F.col("t0"), F.col("t")))
    first = keyed.groupBy("c0", "c", "role", "digest").agg(F.min("t0").alias("t0"), known.alias("known"))
    first = first.select("c0", "c", "t0", F.when(F.col("t0"), F.col("known")).otherwise(F.lit(0)).alias("t"), "role", "digest", F.lit(True).alias("is_first"))
    said = F.rtrim(F.col("text"), F.lit(" \t\n\u000b\f\r"))
    fault = (
        F.when(said == "", BLANK)
        .when(F.col("is_first").isNull(), DUPLICATE)
        .when(~F.substring(said, -1, 1).isin(".", "!", "?"), TRUNCATED)
    )
    return rows.join(first, once, "left").withColumn("fault", fault).drop("is_first", "digest")


TURN = "struct<t0: boolean, turn: bigint, role: string, text: string, copies: bigint, fault: string>"
EDGE = "struct<p: int, q: int, cost: bigint, audit: string, rank: int, path: array<int>>"
EDIT = "struct<edit: string, turn: bigint, role: string, text: string, fault: string, copies: bigint>"
COUNTS = "n_turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, distinct_turns bigint"
ENDS = "first_role string, last_role string, first_turn bigint, last_turn bigint"
_BLOCK = f"c0 boolean, c bigint, part int, seq int, whole boolean, turns array<{TURN}>, edges array<{EDGE}>, {COUNTS}, {ENDS}"
_NODE = f"c0 boolean, c bigint, node bigint, members array<bigint>, edges array<{EDGE}>, {COUNTS}, {ENDS}"
_REPAIRED = f"conv_id bigint, node bigint, whole boolean, edits array<{EDIT}>"
_COUNT_NAMES = [x.split()[0] for x in f"{COUNTS}, {ENDS}".split(", ")]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of the column lists above."""
    plain = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def kind(name: str) -> pa.DataType:
        if name.startswith("array<"):
            return pa.list_(kind(name[6:-1]))
        if name.startswith("struct<"):
            return pa.struct([(n, kind(t)) for n, t in (x.split(": ", 1) for x in fields(name[7:-1]))])
        return plain[name]

    def fields(text: str) -> list[str]:
        out, depth = [""], 0
        for part in text.split(", "):
            out[-1] += (", " if depth else "") + part
            depth += part.count("<") - part.count(">")
            if not depth:
                out.append("")
        return out[:-1]

    return pa.schema([(n, kind(t)) for n, t in (x.split(" ", 1) for x in fields(ddl))])


def join_counts(parts: list[dict]) -> dict:
    """Counts of neighbouring blocks as of one."""
    out = dict(parts[0])
    for b in parts[1:]:
        for name in ("n_turns", "blank", "duplicate", "truncated"):
            out[name] += b[name]
        out["illegal"] += b["illegal"] + (out["last_role"] + b["first_role"] not in LEGAL_PAIRS)
        same = b["first_turn"] is not None and out["last_turn"] == b["first_turn"]
        out["distinct_turns"] += b["distinct_turns"] - same
        for name, choose in (("low", min), ("high", max)):
            known = [x for x in (out[name], b[name]) if x is not None]
            out[name] = choose(known) if known else None
        out["last_role"], out["last_turn"] = b["last_role"], b["last_turn"]
    return out


def block_of(c0: bool, c: int, part: int, seq: int, turns: list[dict], first: bool, whole: bool) -> dict:
    """A block with its items and counts. All copies of a turn but the first are deleted: their D, the same in every
    audit, is left out. ``first``: the conversation begins here; ``whole``: it is this block alone."""
    counted = []
    for x in turns:
        initial, more = x["role"][:1], x["copies"] - 1
        turn = x["turn"] if x["t0"] else None
        counted.append({
            "n_turns": 1 + more, "blank": (1 + more) * (x["fault"] == BLANK), "truncated": int(x["fault"] == TRUNCATED),
            "duplicate": (x["fault"] == DUPLICATE) + (more if x["fault"] != BLANK else 0), "illegal": more,
            "low": turn, "high": turn, "distinct_turns": int(turn is not None),
            "first_role": initial, "last_role": initial, "first_turn": turn, "last_turn": turn,
        })
    units = [turn_edges(x["role"][:1], x["fault"] or "") for x in turns]
    repeated = COSTS[DELETE] * sum(x["copies"] - 1 for x in turns)
    edges = all_edges(units, first, whole)
    for e in edges:
        e["cost"], e["path"] = e["cost"] + repeated, []
    return {"c0": c0, "c": c, "part": part, "seq": seq, "whole": whole, "turns": turns, "edges": edges, **join_counts(counted)}


def blocks(rows: DataFrame, block_turns: int = BLOCK_TURNS, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Sorted turns in blocks, stored: one row per block, in order of ``part``, ``seq`` within a conversation.

    Ranges are cut by conversation, turn, role and the beginning of the text (for the bounds alone), so one conversation
    may span many; within a range the order is by whole text.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "repair-turns")
    parts = max(1, min(MOST_PARTS, max(rows.count() // turns_per_part, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    dealt = rows.withColumn("start", F.substring("text", 1, 64)).repartitionByRange(parts, "c0", "c", "t0", "t", "role", "start")
    ordered = dealt.withColumn("part", F.spark_partition_id()).sortWithinPartitions("c0", "c", "t0", "t", "role", "text")
    ordered = ordered.select("c0", "c", "part", F.struct("t0", F.col("t").alias("turn"), "role", "text", "copies", "fault").alias("turn"))
    schema = arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, seq, out, out_chars = [], 0, 0, [], 0
        here = None  # conversation at hand: (c0, c)
        begins = False  # does it certainly begin in this range?

        def close(part, ends=False):
            nonlocal held, chars, seq, out_chars
            first = begins and seq == 0
            out.append(block_of(*here, part, seq, held, first, first and ends))
            out_chars += chars
            held, chars, seq = [], 0, seq + 1

        part = 0
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 512) for r in batch.slice(at, 512).to_pylist()):
                part, key = row["part"], (row["c0"], row["c"])
                if key != here:
                    if held:
                        close(part, ends=True)
                    begins, here, seq = here is not None, key, 0
                elif held and (len(held) >= block_turns or chars + len(row["turn"]["text"]) > BLOCK_CHARS):
                    close(part)
                held.append(row["turn"])
                chars += len(row["turn"]["text"])
                if len(out) >= 512 or out_chars > BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, out_chars = [], 0
        if held:
            close(part)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return materialize(ordered.mapInArrow(run, _BLOCK), "repair-blocks")


def join_nodes(nodes: DataFrame, bits: int) -> DataFrame:
    """Parents of ``nodes``: the agenda over neighbours, ranks in place of audits."""
    schema = arrow_schema(_NODE)

    def run(key, table: pa.Table) -> pa.Table:
        children = sorted(table.to_pylist(), key=lambda x: x["node"])
        units = []
        for child in children:
            unit: dict[int, dict[int, Edge]] = {}
            for e in child["edges"]:
                unit.setdefault(e["p"], {})[e["q"]] = (e["cost"], chr(e["rank"] + 1))
            units.append(unit)
        starts = {p for p in units[0]}
        edges = all_edges(units, starts == {START})
        for e in edges:
            e["audit"] = ""  # ranks of the children say no more
        node = {"c0": key[0].as_py(), "c": key[1].as_py(), "node": key[2].as_py(), "members": [x["node"] for x in children], "edges": edges}
        return pa.Table.from_pylist([{**node, **join_counts([{k: x[k] for k in _COUNT_NAMES} for x in children])}], schema=schema)

    up = nodes.withColumn("parent", F.shiftright("node", bits))
    return up.groupBy("c0", "c", "parent").applyInArrow(lambda key, t: run(key, t.drop_columns(["parent"])), _NODE)


def root_choice(edges: list[dict]) -> tuple[int, int, int]:
    """(final state, cost, turns inserted at the end) of the lightest repair by the edges of a whole conversation."""
    best = None
    for e in edges:
        if e["p"] == START:
            for inserted, (at, extra) in enumerate(insertions(e["q"])):
                if at in ACCEPTING:
                    value = (e["cost"] + extra, e["rank"], inserted, e["q"])
                    best = value if best is None or value < best else best
    return best[3], best[0], best[2]


def edits_of(block: dict, p: int, q: int, trailing: int) -> list[dict]:
    """The edits of a block on the chosen way, in order; deleted turns too. ``turn`` is NULL for an inserted one."""
    (edge,) = [e for e in block["edges"] if (e["p"], e["q"]) == (p, q)]
    out, state = [], p
    turns = iter(block["turns"])

    def insert():
        nonlocal state
        initial = next_inserted(state)
        state = STEPS[state, initial]
        out.append({"edit": INSERT, "turn": None, "role": ROLES[initial], "text": "", "fault": None, "copies": 1})

    for mark in edge["audit"]:
        if mark == INSERT:
            insert()
            continue
        x = next(turns)
        role = x["role"]
        if mark != DELETE:
            initial = role[:1] if mark == KEEP else next_inserted(state)
            role = role if mark == KEEP else ROLES[initial]
            state = STEPS[state, initial]
        one = {"edit": mark, "turn": x["turn"] if x["t0"] else None, "role": role, "text": x["text"], "fault": x["fault"], "copies": 1}
        out.append(one)
        if x["copies"] > 1:
            again = BLANK if x["fault"] == BLANK else DUPLICATE
            out.append({**one, "edit": DELETE, "role": x["role"], "fault": again, "copies": x["copies"] - 1})
    for _ in range(trailing):
        insert()
    return out


def repair(turns: DataFrame, block_turns: int = BLOCK_TURNS, turns_per_part: int = TURNS_PER_PART, fan_bits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Lightest repairs of all conversations: (edits, summary).

    ``turns`` has ``conv_id, turn, role, text`` and may have ``copies`` (how often a row stands, default 1). Its rows go by turn
    (NULL first), then role, then text. A row without role counts as one with a role of no initial and cannot be kept. NULL text
    counts as empty. NULL is a conversation like any other. Repeated rows are duplicates. Result:

    * ``edits``: ``conv_id, node, whole, edits``, one row per block of a conversation in order of ``node`` (``whole``: its only block); an edit has ``edit`` (K, R,
      D, I), ``turn, role`` (after the edit), ``text, fault, copies``.
    * ``summary``: ``conv_id, n_turns, blank, duplicate, truncated, illegal, low, high, distinct_turns, cost``: one row per conversation.

    An empty table gives empty results.
    """
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    turns = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text_of("role").alias("role"), text_of("text").alias("text"), copies.alias("copies"),
    )
    found = blocks(faults(turns), block_turns, turns_per_part)
    widest = found.agg(F.max("seq")).first()[0] or 0
    seq_bits = int(widest).bit_length()
    node = F.shiftleft(F.col("part").cast("long"), seq_bits) + F.col("seq")
    found = found.withColumn("node", node)
    # Conversations at the ends of a range may go on in the next one, or not.
    unsure = found.filter("NOT whole")
    per = unsure.groupBy("c0", "c").agg(F.count(F.lit(1)).alias("n_blocks"))
    split = materialize(per.filter("n_blocks > 1").select("c0", "c"), "repair-split")
    whole = found.filter("whole").unionByName(unsure.join(split, ["c0", "c"], "left_anti"))
    pieces = unsure.join(split, ["c0", "c"], "left_semi")

    # Up: blocks to groups of blocks, until a conversation is one node.
    level = pieces.select("c0", "c", "node", F.lit(None).cast("array<bigint>").alias("members"), "edges", *_COUNT_NAMES)
    levels: list[DataFrame] = []
    if not split.isEmpty():
        bits = seq_bits + MOST_PARTS.bit_length()
        while bits > 0:
            level = materialize(join_nodes(level, fan_bits), f"repair-level-{len(levels)}")
            levels.append(level)
            bits -= fan_bits
    # At the top, and for conversations of one block: the final state, and turns inserted at the end.
    roots = (levels[-1] if levels else level).select("c0", "c", "node", "edges", *_COUNT_NAMES)
    lone = whole.select("c0", "c", "node", "edges", *_COUNT_NAMES)
    chosen = choose_roots(roots)
    for parent in reversed(levels):
        chosen = materialize(go_down(chosen, parent), "repair-chosen")
    edits = write_edits(whole.select("c0", "c", "node", "turns", "edges").withColumns({"p": F.lit(START), "q": F.lit(-1), "trailing": F.lit(0)}))
    if levels:
        edits = edits.unionByName(write_edits(
            pieces.select("c0", "c", "node", "turns", "edges").join(chosen.select("c0", "c", "node", "p", "q", "trailing"), ["c0", "c", "node"])
        ))
    summary = choose_roots(lone)
    if levels:
        summary = summary.unionByName(choose_roots(roots))
    names = [x.split()[0] for x in COUNTS.split(", ")]
    return edits, summary.select(conv_id_of().alias("conv_id"), *names, "cost")


def conv_id_of() -> Column:
    return F.when(F.col("c0"), F.col("c"))


def choose_roots(roots: DataFrame) -> DataFrame:
    """The final state, cost and closing insertions of every root."""
    shape = f"c0 boolean, c bigint, node bigint, p int, q int, cost bigint, trailing int, {COUNTS}"
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = [root_choice(e) for e in batch.column("edges").to_pylist()]
            extra = [pa.array([START] * len(picked), pa.int32())]
            extra += [pa.array([x[i] for x in picked], kind) for i, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.int32()))]
            columns = [batch.column(n) for n in ("c0", "c", "node")] + extra + [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=["c0", "c", "node", "p", "q", "cost", "trailing", *names])

    return roots.mapInArrow(run, shape)


def go_down(chosen: DataFrame, parent: DataFrame) -> DataFrame:
    """The choice of every node to its members: the states between them, and closing insertions to the last."""
    ways = parent.select("c0", "c", "node", "members", F.explode("edges").alias("e")).select(
        "c0", "c", "node", "members", F.col("e.p").alias("p"), F.col("e.q").alias("q"), F.col("e.path").alias("path")
    )
    taken = chosen.select("c0", "c", "node", "p", "q", "trailing").join(ways, ["c0", "c", "node", "p", "q"])
    each = taken.select("c0", "c", "trailing", "path", F.size("members").alias("n"), F.posexplode("members").alias("i", "node"))
    return each.select(
        "c0", "c", "node", F.get("path", F.col("i")).alias("p"), F.get("path", F.col("i") + 1).alias("q"),
        F.when(F.col("i") + 1 == F.col("n"), F.col("trailing")).otherwise(F.lit(0)).alias("trailing"),
    )


def write_edits(placed: DataFrame) -> DataFrame:
    """Edits of blocks with a chosen way ``p, q, trailing``; q is -1 for a block that is a whole conversation."""
    schema = arrow_schema(_REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for b in batch.slice(at, 64).to_pylist():
                    q, trailing = b["q"], b["trailing"]
                    if q < 0:
                        q, _, trailing = root_choice(b["edges"])
                    out.append({"conv_id": b["c"] if b["c0"] else None, "node": b["node"], "whole": b["q"] < 0, "edits": edits_of(b, b["p"], q, trailing)})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return placed.mapInArrow(run, _REPAIRED)


def repaired_turns(edits: DataFrame) -> DataFrame:
    """``conv_id, node, place, edit, turn, role, text``: the turns of the repaired conversations, in order of node and place."""
    each = edits.select("conv_id", "node", F.posexplode("edits").alias("place", "e")).select("conv_id", "node", "place", "e.*")
    return each.filter(F.col("edit") != DELETE).drop("fault", "copies")


def digests(edits: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256``: edits in order, and the hash of all ``role:text`` joined by newlines.

    A block sends one row, its text joined. The hash of one conversation is sequential by definition: its blocks
    stream in order through one task that holds one block at a time and the audit, which is one cell of the result.
    """
    lines = F.transform(F.filter("edits", lambda e: e["edit"] != DELETE), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    marks = F.transform("edits", lambda e: F.repeat(e["edit"], e["copies"].cast("int")))
    joined = edits.select(
        F.col("conv_id").isNotNull().alias("c0"), F.coalesce("conv_id", F.lit(0)).alias("c"), "node", "whole",
        F.array_join(marks, "").alias("audit"), F.array_join(lines, "\n").alias("said"), (F.size(lines) > 0).alias("speaks"),
    )
    ordered = joined.filter("NOT whole").repartition("c0", "c").sortWithinPartitions("c0", "c", "node")
    names = ["c0", "c", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        here, audit, state, spoken = None, [], None, False
        for batch in batches:
            out = []
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                key = (row["c0"], row["c"])
                if key != here:
                    if here is not None:
                        out.append((*here, "".join(audit), state.hexdigest()))
                    here, audit, state, spoken = key, [], hashlib.sha256(), False
                audit.append(row["audit"])
                if row["speaks"]:
                    state.update(("\n" if spoken else "").encode() + row["said"].encode("utf-8", "replace"))
                    spoken = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*here, "".join(audit), state.hexdigest())], names=names)

    streamed = ordered.mapInArrow(run, "c0 boolean, c long, audit string, repaired_sha256 string")
    direct = joined.filter("whole").select("c0", "c", "audit", F.sha2("said", 256).alias("repaired_sha256"))
    return direct.unionByName(streamed).select(conv_id_of().alias("conv_id"), "audit", "repaired_sha256")


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: a fifth of the rows dropped, emptied, cut short, repeated or reroled, by hash of place.

    NULL conversation, turn, role and text read as one blank (the first two only in the hash).
    """
    def blank(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return turns.filter(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def summarize(turns: DataFrame, edits: DataFrame, summary: DataFrame) -> DataFrame:
    """One row for every conversation of ``turns``, also for those of which no row was left."""
    def keyed(frame):
        return frame.withColumns({"c0": F.col("conv_id").isNotNull(), "c": F.coalesce(F.col("conv_id").cast("long"), F.lit(0))})

    every = keyed(turns.select("conv_id")).select("c0", "c").distinct()
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct_turns"), F.lit(0)).alias("gaps")
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost"]
    joined = every.join(keyed(summary).drop("conv_id"), ["c0", "c"], "left").join(keyed(digests(edits)).drop("conv_id"), ["c0", "c"], "left")
    return joined.select(
        conv_id_of().alias("conv_id"), gaps, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
