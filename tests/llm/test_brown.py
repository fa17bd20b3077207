import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from basketry.llm import brown


def counts(rows):
    tokens = [(d, [*brute.words((t or "").translate(brute.LOWER)), ""]) for d, t in rows]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in tokens if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    key = lambda x: (str(x[0]), x[2])
    return sorted([(d, out(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens], key=key), c


def told(frame):
    rows = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in frame.collect()]
    return sorted(rows, key=lambda x: (str(x[0]), x[2]))


def test_base_of_whole_table_and_better_held_out_scores(documents):
    got = brown.scores(documents, classes=16)
    want, _ = counts([(r["doc_id"], r["text"]) for r in documents.collect()])
    for a, b in zip(told(got), want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    held = [r for r in got.collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got.collect())


def test_odd_rows(odd, none, clashing, monkeypatch):
    monkeypatch.setattr(brown, "CHUNK_VOCABULARY", 50)
    got = brown.scores(odd, classes=4)
    want, _ = counts([(r["doc_id"], r["text"]) for r in odd.collect()])
    for a, b in zip(told(got), want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert brown.scores(none).count() == 0
    assert told(brown.scores(clashing, classes=4)) == told(got)


def test_probabilities_sum_to_one():
    pairs = np.array([[3, 1, 0], [0, 5, 2], [4, 0, 0]])
    of_class, kinds, d = np.array([7.0, 6.0, 2.0]), np.array([2.0, 3.0, 2.0]), 0.4
    t = 10 ** brown.transitions(pairs, of_class, kinds, d)
    known = 1 - d * kinds / of_class  # what the words of a class have left
    assert np.allclose(t[:, :3] @ known + t[:, 3], 1)


def likelihood(stream, cls, k):
    pairs, total = Counter(zip([cls[w] for w in stream[:-1]], [cls[w] for w in stream[1:]], strict=True)), Counter(cls[w] for w in stream[1:])
    f = lambda x: x * math.log(x) if x else 0.0
    return sum(map(f, pairs.values())) - 2 * sum(map(f, total.values()))


def test_an_exchange_raises_the_likelihood_most():
    rng = np.random.default_rng(4)
    k, words = 4, 12
    stream = [0, *rng.integers(0, words, 400).tolist(), 0]
    cls = np.array([w % k for w in range(words)])
    pairs = np.zeros((k, k), int)
    seen = Counter()
    for a, b in zip(stream[:-1], stream[1:], strict=True):
        pairs[cls[a], cls[b]] += 1
        seen[a, int(cls[b])] += 1
        seen[b, k + int(cls[a])] += 1
    keys = sorted(seen)
    got = brown.best_classes(np.array([x[0] for x in keys]), np.array([x[1] for x in keys]), np.array([seen[x] for x in keys]), cls, pairs)
    better = 0
    for w in range(words):
        moved = cls.copy()
        moved[w] = got[w]
        better += likelihood(stream, moved, k) >= likelihood(stream, cls, k) - 1.0
    assert better >= words - 1
