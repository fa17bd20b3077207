import brute
import pytest
from pyspark.sql import functions as F

from basketry.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PROBE = "\\### Assistant: </turn> ok"


def digest(rows, spark, **kw):
    out = chat.samples(spark.createDataFrame(rows, SCHEMA), **kw)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(out).collect()}


def turns(n, words=30, system=True):
    rows = [(0, "system", "be brief")] if system else []
    return rows + [(i + 1, "user" if i % 2 == 0 else "assistant", f"<t{i}> \\l " + f"w{i} " * (words + i % 7)) for i in range(n)]


@pytest.mark.parametrize("budget", [20, 64, 200, 1024])
def test_every_turn_is_read_back_once(spark, budget):
    talks = {1: turns(25), 2: turns(9, system=False), 3: [(0, "user", PROBE), (1, "assistant", PROBE)], 4: [(0, "assistant", "")]}
    rows = [(c, *t) for c, ts in talks.items() for t in ts]
    assert digest(rows, spark, budget=budget) == {c: brute.chat(ts) for c, ts in talks.items()}


def test_windows_hold_their_budget_and_repeat_history(spark):
    frame = spark.createDataFrame([(1, *t) for t in turns(40, 12)], SCHEMA)
    got = chat.samples(frame, budget=160, history=2).orderBy("span").collect()
    assert len(got) > 3 and all(r["tokens"] <= 160 and not r["over_budget"] for r in got)
    assert all(r["formatted"].startswith("<turn system>") for r in got)
    assert got[0]["n_repeated"] == 0 and all(r["n_repeated"] in (2, 3) for r in got[1:])
    targets = [r["formatted"][a : a + n] for r in got for a, n in zip(r["loss_start"], r["loss_length"], strict=True)]
    assert len(targets) == 20 == len(set(targets))


def test_escape_is_reversible(spark):
    texts = [PROBE, "\\l", "\\bl", "<", "\\<\\", "</turn>\n<turn system>", "\\\\ll\\b", "é\U0001f600<", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, back in frame.select("t", chat.escaped(F.col("t")), chat.unescaped(chat.escaped(F.col("t")))).collect():
        assert back == t and "<" not in e


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (None, None, "assistant", "y"),
        (2, 0, None, "t"), (3, 5, "we<ird>\n\"role\\", "t"), (4, 0, "system", "only"), (5, 0, "user", "w " * 30_000), (5, 1, "assistant", "z " * 30_000),
    ]
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((-1 if t is None else t, r, x))
    assert digest(rows, spark) == {c: brute.chat(ts) for c, ts in talks.items()}
    assert chat.samples(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({"span": F.lit("own"), "places": F.lit(1), "tokens": F.lit("x")})
    assert chat.samples(extra).count() > 0


def test_whole_table(spark, documents):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    talks = {}
    for r in frame.collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = chat.read_back(chat.samples(frame.unionByName(chat.probe(spark)))).collect()
    talks[-7] = [(0, "user", PROBE), (1, "assistant", PROBE)]
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {c: brute.chat(t) for c, t in talks.items()}


def test_the_system_turn_opens_every_window_of_a_long_conversation(spark):
    """A conversation with most of all rows, and one without a number: each window begins with its own system turn."""
    rows = [(9, 0, "system", "rules of nine"), (None, 0, "system", "rules of none"), (8, 0, "user", "hi")]
    rows += [(c, t, ("assistant", "user")[t % 2], f"turn {t} " + "word " * 20) for c, n in ((9, 3000), (None, 400)) for t in range(1, n)]
    windows = chat.samples(spark.createDataFrame(rows, SCHEMA), budget=300).collect()
    for conv, said in ((9, "rules of nine"), (None, "rules of none")):
        own = [w for w in windows if w["conv_id"] == conv]
        assert len(own) > 20 and all(w["formatted"].startswith(f"<turn system>{said}</turn>") and w["formatted"].count(said) == 1 for w in own)
        assert len({w["span"] for w in own}) == len(own)
