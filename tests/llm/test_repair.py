import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from stintworks.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, copies string, fault string, node string, part string, c string, t0 string"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        place = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(place.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def brute_faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def exhaustive(rows, faults):
    """Cheapest, then ASCII-least repair by trying every edit; deleting all bounds the cost."""
    best = [(2 * len(rows), "D" * len(rows), [])]

    def go(i, initials, cost, audit, said, inserted):
        if (cost, audit) > best[0][:2] and cost >= best[0][0] and not best[0][1].startswith(audit):
            if cost > best[0][0]:
                return
        if cost > best[0][0]:
            return
        if i == len(rows) and LEGAL.fullmatch(initials) and (cost, audit) < best[0][:2]:
            best[0] = (cost, audit, said)
        for role in ("user", "assistant"):
            if inserted < 3:
                go(i, initials + role[0], cost + 5, audit + "I", said + [role + ":"], inserted + 1)
        if i == len(rows):
            return
        role, text = rows[i][2:]
        go(i + 1, initials, cost + 2, audit + "D", said, 0)
        if faults[i] in ("blank", "duplicate"):
            return
        extra = 5 if faults[i] == "truncated" else 0
        if role:
            go(i + 1, initials + role[0], cost + extra, audit + "K", said + [f"{role}:{text}"], 0)
        for other in ("user", "assistant"):
            go(i + 1, initials + other[0], cost + 1 + extra, audit + "R", said + [f"{other}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    return best[0]


def by_states(rows, faults):
    """The same by dynamic programming over turns, for long conversations."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    now = {"": (0, "", [])}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for q, (cost, audit, said) in list(out.items()):
                role = "assistant" if q == "u" else "user"
                new = (cost + 5, audit + "I", said + [role + ":"])
                to = step[q, role[0]]
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}

        def offer(q, value):
            if q not in after or value[:2] < after[q][:2]:
                after[q] = value

        for many in (now, inserted(now)):
            for q, (cost, audit, said) in many.items():
                offer(q, (cost + 2, audit + "D", said))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 5 if fault == "truncated" else 0
                if (q, role[:1]) in step:
                    offer(step[q, role[:1]], (cost + extra, audit + "K", said + [f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    if (q, other[0]) in step:
                        offer(step[q, other[0]], (cost + 1 + extra, audit + "R", said + [f"{other}:{text}"]))
        now = after
    ends = [inserted(now).get(q) for q in ("", "a")] + [now.get(q) for q in ("", "a")]
    return min((e for e in ends if e), key=lambda e: e[:2])


def brute(rows):
    convs, out = defaultdict(list), []
    for r in brute_damage(rows):
        convs[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        mine = in_order(convs[conv])
        faults = brute_faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, said = by_states(mine, faults)
        if len(mine) <= 5:
            assert exhaustive(mine, faults) == (cost, audit, said)
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def query(spark, rows, **sizes):
    turns = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)
    edits, summary = repair.repair(repair.damage(turns), **sizes)
    out = repair.summarize(turns, edits, summary)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert out.columns == columns
    return sorted((tuple(r) for r in out.collect()), key=repr)


def random_rows(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = rng.choice(["ok.", "ok.", f"t{rng.randrange(99)}!", "no end", "", " \t", "é日?", "a.\n", "b. "])
            rows.append((conv, turn + (turn > 2), role, text))
    return rows


def test_blocks_join_like_one(spark):
    rng = random.Random(1)
    rows = random_rows(rng, 60, 6) + [(1000, t, rng.choice(["user", "assistant"]), rng.choice(["x.", "y", f"{t}."])) for t in range(300)]
    want = brute(rows)
    assert query(spark, rows) == want
    assert query(spark, rows, block_turns=4, turns_per_part=16, fan_bits=2) == want
    assert query(spark, rows, block_turns=1, turns_per_part=50, fan_bits=3) == want


def test_nulls_repeated_rows_and_ties(spark):
    rng = random.Random(2)
    rows = random_rows(rng, 20, 5)
    rows += rows[:9] + [(None, None, None, None)] * 3 + [(None, None, "user", "hi."), (None, 3, "assistant", "yes."), (5, None, "user", None)]
    rows += [(7, 1, "user", f"tie {i}.") for i in range(6)] + [(8, None, None, "x.")] * 50 + [(9, 2, "assistant", "same.")] * 40
    rows += [(10, t, "user", "same again.") for t in range(60)] + [(11, -(2**40), "user", "a."), (11, 2**40, "assistant", "b.")]
    want = brute(rows)
    assert query(spark, rows) == want
    assert query(spark, rows, block_turns=3, turns_per_part=8, fan_bits=1) == want


def test_empty_table_and_very_long_text(spark):
    assert query(spark, []) == []
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "z" * 1_000_000), (2, 0, "user", "q?"), (2, 1, "assistant", "a.")]
    assert query(spark, rows) == brute(rows)


def test_repaired_turns_are_legal(spark):
    rows = random_rows(random.Random(3), 50, 8)
    turns = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)
    edits, _ = repair.repair(turns.drop("copies"), block_turns=3, turns_per_part=20)
    spoken = defaultdict(list)
    for r in repair.repaired_turns(edits).collect():
        spoken[r["conv_id"]].append((r["node"], r["place"], r["role"][0]))
    assert spoken and all(LEGAL.fullmatch("".join(x for *_, x in sorted(s))) for s in spoken.values())


def test_agenda_pops_the_goal_first():
    units = [repair.turn_edges(x, "") for x in "usau"]
    ways = repair.lightest(units, repair.START)
    (goal,) = repair.lightest(units, repair.START, goal=True).items()
    assert ways[goal[0]] == goal[1] and goal[0] in repair.ACCEPTING
