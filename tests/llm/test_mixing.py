import random

import numpy as np
import pytest

from basketry.llm import mixing


def test_targets_stop_at_their_limit_and_reshare():
    sizes = {"a": 100, "b": 1000, None: 1000, "Z": 50}
    got = mixing.targets(sizes)
    # by code point: Z 3, a 1, b 2, null 3; 3225 words in all
    assert got["Z"] == 100 and got["a"] == 200
    assert sum(got.values()) == pytest.approx(3225) and got[None] == pytest.approx(2925 * 3 / 5) and got["b"] == pytest.approx(2925 * 2 / 5)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_rounding_keeps_the_sum_and_the_expectation():
    draw = random.Random(3)
    sizes = [draw.randint(1, 50) for _ in range(40)]
    p = np.array([draw.random() for _ in sizes])
    mean = np.zeros(len(p))
    for seed in range(2000):
        after, held = mixing.round_pairs(range(len(p)), sizes, p, seed)
        assert np.dot(after, sizes) == pytest.approx(np.dot(p, sizes))
        assert all(x in (0, 1) for i, x in enumerate(after) if i != held)
        mean += after
    assert np.abs(mean / 2000 - p).max() < 0.05


def test_each_source_comes_near_its_target(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 3)  # several levels of the tree
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    got = mixing.mix(documents).collect()
    again = mixing.mix(documents.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    taken, target = {}, {}
    for r in got:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    longest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= longest / 2 + 1e-6 for s in taken)


def test_odd_rows(odd, none, clashing):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.filter("size = 0 AND taken <> 0").count() == 0
    assert mixing.mix(none).count() == 0
    more = mixing.resampled(clashing)
    assert more.columns == clashing.columns and more.count() == got.agg({"copies": "sum"}).first()[0]
    assert more.distinct().exceptAll(clashing.distinct()).count() == 0
