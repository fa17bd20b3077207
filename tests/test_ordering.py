import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators.ordering import largest_group, number_rows, previous, quantiles, running_totals, with_group_total

BOTH_WAYS = pytest.mark.parametrize("limit", [10**6, 1], ids=["windowed", "ranged"])


@pytest.fixture(scope="module")
def skewed(spark):
    """One key and the null key hold most rows; many orders tie on `t`."""
    rng = random.Random(7)
    data = [(rng.choice(["hot"] * 6 + [None] * 3 + list("abc")), rng.randint(0, 5), i, rng.random()) for i in range(600)]
    return data, spark.createDataFrame(data, "k string, t int, id int, v double").repartition(5).cache()


def groups(data):
    found = {}
    for row in data:
        found.setdefault(row[0], []).append(row)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in found.items()}


@BOTH_WAYS
def test_number_rows(skewed, limit):
    data, df = skewed
    got = {(r.k, r.id): r.n for r in number_rows(df, "k", ["t", "id"], "n", group_rows=limit).collect()}
    want = {(k, r[2]): i for k, v in groups(data).items() for i, r in enumerate(v, 1)}
    assert got == want


@BOTH_WAYS
def test_number_rows_without_groups(skewed, limit):
    data, df = skewed
    got = {r.id: r.n for r in number_rows(df, None, [F.col("t").desc(), "id"], "n", group_rows=limit).collect()}
    want = {r[2]: i for i, r in enumerate(sorted(data, key=lambda r: (-r[1], r[2])), 1)}
    assert got == want


@BOTH_WAYS
def test_running_totals(skewed, limit):
    data, df = skewed
    got = {(r.k, r.id): r.s for r in running_totals(df, "k", ["t", "id"], {"s": F.col("id")}, group_rows=limit).collect()}
    want = {}
    for k, v in groups(data).items():
        total = 0
        for r in v:
            total += r[2]
            want[(k, r[2])] = total
    assert got == want


@BOTH_WAYS
def test_previous(skewed, limit):
    data, df = skewed
    got = {(r.k, r.id): r.p for r in previous(df, "v", "k", ["t", "id"], "p", group_rows=limit).collect()}
    want = {(k, r[2]): (v[i - 1][3] if i else None) for k, v in groups(data).items() for i, r in enumerate(v)}
    assert got == want


@BOTH_WAYS
def test_quantiles(skewed, limit):
    data, df = skewed
    ps = [0.0, 0.1, 0.5, 0.99, 1.0]
    for col, at in (("v", 3), ("t", 1)):
        got = {(r.k, r.p): r.value for r in quantiles(df, col, ps, "k", distinct_values=limit).collect()}
        want = {(k, p): np.percentile([r[at] for r in v], p * 100) for k, v in groups(data).items() for p in ps}
        assert got.keys() == want.keys()
        assert all(abs(got[key] - want[key]) < 1e-9 for key in want)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles(empty, "x", [0.5]).collect() == []


def test_group_totals_match_null_keys(skewed):
    data, df = skewed
    got = with_group_total(df, "k", {"n": F.count(F.lit(1))}).filter("k is null").select("n").distinct().collect()
    assert [r.n for r in got] == [sum(r[0] is None for r in data)]


def test_largest_group(skewed):
    data, df = skewed
    assert largest_group(df, ["k"]) == max(len(v) for v in groups(data).values())
