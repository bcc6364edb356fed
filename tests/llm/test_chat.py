import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stintworks.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "~0~1~2 ~", "[[[", "<", "[/INST]</s>", "", "été 🙂 日本", "\\ $1 \n", "~~0<[~2"]


@pytest.fixture(scope="module")
def turns():
    rows = []
    for conv in range(12):
        for turn in range(conv + 1):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", NASTY[(conv + turn) % len(NASTY)]))
    rows += [(50, 1, "assistant", "b"), (50, 0, "assistant", "a"), (50, 1, "user", "tie"), (51, None, "assistant", "late"), (51, 5, "user", None)]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (52, 0, None, "no role"), (53, 0, "user", "same"), (53, 0, "user", "same"), (54, 0, "odd[INST]<role", "z")]
    rows += [(99, t, ["user", "assistant"][t % 2], f"turn {t} [x") for t in range(700)]  # several blocks
    return rows


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, each in convs.items():
        each.sort()
        said = "".join(t for _, _, r, t in each if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = len(each), digest("".join(f"{r}\n{t}\n" for _, _, r, t in each)), len(said), digest(said)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, `start` string, target string")


def test_round_trip(spark, turns):
    out = chat.read_back(*chat.format_chats(frame(spark, turns))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out} == brute(turns)


def test_every_reply_is_an_example_with_all_earlier_turns(spark, turns):
    stream, examples = chat.format_chats(frame(spark, turns), block=64)
    rendered = {(r["conv_id"], r["turn_no"]): r for r in chat.render(examples, stream).collect()}
    assert len(rendered) == sum(1 for r in turns if r[2] == "assistant")
    whole = {r["conv_id"]: r["formatted"] for r in chat.streams(stream).collect()}
    for (conv, turn_no), r in rendered.items():
        assert whole[conv].startswith(r["prompt"] + r["reply"])
        assert r["prompt"].count(chat.OPEN) == turn_no + 1 and r["reply"].endswith(chat.CLOSE)
        assert not any(mark in r["reply"][: -len(chat.CLOSE)] for mark in (chat.OPEN, chat.MIDDLE, chat.CLOSE))


def test_escape_is_reversible(spark):
    rows = spark.createDataFrame([(t,) for t in NASTY], "t string")
    for r in rows.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["t"] == r["u"] and "<" not in r["e"] and "[" not in r["e"]


def test_empty(spark):
    stream, examples = chat.format_chats(frame(spark, []))
    assert chat.read_back(stream, examples).collect() == [] and chat.render(examples, stream).collect() == []


def test_output_grows_with_the_turns(spark):
    """One conversation of n turns gives n segments and n/2 short rows, not all prefixes."""
    stream, examples = chat.format_chats(frame(spark, [(1, t, ["user", "assistant"][t % 2], "word") for t in range(1000)]))
    assert stream.count() == 1000 and examples.count() == 500 and "formatted" not in examples.columns
