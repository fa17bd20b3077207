import random
import re

import brute
import numpy as np
import pytest

from basketry.llm import substrings
from basketry.llm.fm_index import FMIndex, WaveletMatrix


def result(frame, **kw):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.deduplicated(frame, **kw).collect()}


def planted(seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 3)))
    passages = [[word() for _ in range(n)] for n in (50, 51, 80, 200)]
    docs = {}
    for d in range(60):
        text = []
        for _ in range(draw.randint(0, 4)):
            text += [word() for _ in range(draw.randint(0, 70))]
            p = draw.choice(passages)
            cut = p[draw.randint(0, 3) : len(p) - draw.randint(0, 3)]
            if draw.random() < 0.3:
                cut = [w if i != len(cut) // 2 else "X" for i, w in enumerate(cut)]
            text += cut
        docs[d * 3] = "\t ".join(text)
    docs[1000] = "same " * 300
    docs[1001] = "same " * 120
    docs[7] = docs[9]
    return docs


@pytest.mark.parametrize("shard_words", [10**6, 2000, 100])
def test_against_plain_python(spark, shard_words):
    docs = planted()
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert result(frame, shard_words=shard_words) == brute.substrings(docs)


def test_whole_table(documents):
    assert result(documents) == brute.substrings({r["doc_id"]: r["text"] for r in documents.collect()})


def test_odd_rows(odd, none, clashing):
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.deduplicated(odd).collect())
    assert len(got) == odd.count()
    assert ("7", 12_001, 12_000) in got and ("6", 12_000, 0) in got and ("2", 26, 0) in got and ("3", 0, 0) in got
    assert substrings.deduplicated(none).count() == 0
    assert substrings.deduplicated(clashing).count() == odd.count()


def test_texts_are_dealt_once(spark, odd, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    docs = planted()
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), len(spark.catalog.listTables())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = substrings.deduplicated(frame)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # the lists of ranges go to the buckets of texts, which stay where they are
        assert len(re.findall(r"hashpartitioning\(doc_id#\d+L?, tid#\d+L?", plan)) == 1
        assert "Bucketed: true" in plan
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()} == brute.substrings(docs)
        got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.deduplicated(odd).collect()]
        assert len(got) == odd.count() and (7, 12_001, 12_000) in got and got.count((None, 0, 0)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
    assert len(spark.catalog.listTables()) == before[1]


def test_ranks_and_backward_search():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 9, 700), 0)
    matrix = WaveletMatrix(text, 9)
    at = rng.integers(0, 702, 300)
    for symbol in range(9):
        s = np.full(300, symbol)
        count = matrix.place(s, at) - matrix.place(s, np.zeros(300, int))
        assert count.tolist() == [int((text[:a] == symbol).sum()) for a in at]
    index = FMIndex(text, 9, 4)
    low, high = np.array([0]), np.array([index.n])
    for symbol in text[100:104][::-1]:
        low, high = index.extend(np.array([symbol]), low, high)
    found = sorted(index.positions[low[0] : high[0]].tolist())
    assert found == [i for i in range(698) if (text[i : i + 4] == text[100:104]).all()]
