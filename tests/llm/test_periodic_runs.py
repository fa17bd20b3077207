import hashlib
import random
from fractions import Fraction
from zlib import crc32

import brute
import numpy as np
import pytest

from basketry.llm import periodic_runs


def plain_runs(w, shortest=24, times=3):
    """Every stretch whose words equal those q further, for every q; the smallest period of each."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(doc_id, text, planted):
    w = brute.words(text)
    h = crc32(str("" if doc_id is None else doc_id).encode())
    if planted and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def result(frame, **kw):
    return sorted(map(tuple, periodic_runs.detected(frame, **kw).collect()), key=repr)


def repeats(seed, texts=150):
    draw = random.Random(seed)
    out = []
    for _ in range(texts):
        w = []
        for _ in range(draw.randint(0, 5)):
            w += [draw.randint(0, draw.choice([1, 3, 50])) for _ in range(draw.randint(0, 40))]
            period = [draw.randint(0, draw.choice([1, 3, 50])) for _ in range(draw.randint(1, 15))]
            w += (period * 12)[: draw.randint(0, 100)]
        out.append(w)
    return out


@pytest.mark.parametrize(("shortest", "times"), [(24, 3), (8, 3), (10, 2), (30, 5)])
def test_runs_of_random_repeats(shortest, times):
    texts = repeats(shortest)
    got = periodic_runs.runs([np.array(t, np.int64) for t in texts], shortest, times)
    assert got == [plain_runs(t, shortest, times) for t in texts]
    assert sum(map(len, got)) > 50


def test_long_loops():
    n = 40_000
    for period in (1, 7, 1000, n // 3):
        text = np.arange(n) % period
        assert periodic_runs.runs([text]) == [[(0, n, period)]]
    text = np.concatenate([np.arange(100), np.arange(60) % 20, np.arange(100)])  # 20 words three times; the words before go on
    assert periodic_runs.runs([text]) == [plain_runs(text.tolist())]


def test_suffix_order_and_agreement():
    keys = np.array([2, 1, 2, 1, 2, 1, 1, 3])
    levels = periodic_runs.ranked(keys)
    assert np.argsort(levels[-1][:-1]).tolist() == sorted(range(8), key=lambda i: (keys[i:].tolist() + [9],))
    assert periodic_runs.agreement(levels, np.array([0, 1, 0]), np.array([2, 3, 1])).tolist() == [4, 3, 0]


@pytest.mark.parametrize("group_words", [10**6, 50])
@pytest.mark.parametrize("planted", [True, False])
def test_against_plain_python(spark, group_words, planted):
    docs = [(i, " \t".join(f"w{x}" for x in t)) for i, t in enumerate(repeats(5))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(frame, planted=planted, group_words=group_words) == sorted((plain(d, t, planted) for d, t in docs), key=repr)


def test_whole_table(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect() if len(r["text"] or "") < 20_000]
    from pyspark.sql import functions as F

    frame = documents.filter(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
    assert result(frame, planted=True) == sorted((plain(d, t, True) for d, t in rows), key=repr)


def test_odd_rows(odd, none, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted((plain(d, t, False) for d, t in rows), key=repr)
    assert result(odd) == want
    assert result(clashing) == want
    got = {r[0]: r for r in result(odd, planted=True)}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[3][1:] == (0, None, None, None, None, empty, empty) and got[5][1:] == got[3][1:]
    assert periodic_runs.detected(none).count() == 0
