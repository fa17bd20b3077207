import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from basketry.plans import boosting, demand, models
from basketry.plans.boosting import MISSING, Options

COLS = ("a", "b", "c")


def plain_tree(bins, g, h, option, columns):
    """Depth-first exact search over all (feature, cut, side of the missing); {heap place: (feature, cut, missing_left)} and leaf values."""
    splits, leaves = {}, {}

    def grow(rows, node, depth):
        total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = None
        if depth < option.depth:
            for f in columns:
                cuts = sorted({bins[i][f] for i in rows if bins[i][f] != MISSING})
                for missing_left in (False, True):
                    for cut in cuts:
                        left = [i for i in rows if (missing_left if bins[i][f] == MISSING else bins[i][f] <= cut)]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gr, hr = total_g - gl, total_h - hl
                        if hl < option.child_weight or hr < option.child_weight or not left or len(left) == len(rows):
                            continue
                        gain = (gl**2 / (hl + option.l2) + gr**2 / (hr + option.l2) - total_g**2 / (total_h + option.l2)) / 2
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, cut, missing_left, left)
        if best is None:
            leaves[node] = -option.rate * total_g / (total_h + option.l2)
            return
        splits[node] = (best[1], best[2], best[0])
        left = set(best[4])
        grow([i for i in rows if i in left], 2 * node + 1, depth + 1)
        grow([i for i in rows if i not in left], 2 * node + 2, depth + 1)

    grow(list(range(len(bins))), 0, 0)
    return splits, leaves


def table(spark, n=300, seed=3, parts=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = draw.gauss(0, 1), float(draw.randint(0, 5)), draw.random()
        y = 3 * (a > 0.3) + b * (c > 0.5) + draw.gauss(0, 0.1)
        rows.append((i, a if i % 11 else None, b, float("nan") if i % 7 == 0 else c, round(y, 4)))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double").repartition(parts)


@pytest.fixture(scope="module")
def some(spark):
    return table(spark)


@pytest.mark.parametrize("logistic", [False, True])
def test_trees_equal_an_exhaustive_search(spark, some, logistic):
    df = some.withColumn("y", (F.col("y") > 2).cast("double")) if logistic else some
    option = Options(COLS, rounds=4, depth=3, child_weight=3.0 if not logistic else 1.0, rate=0.3, rows=1.0, columns=1.0)
    weight = F.when(F.col("y") == 1, 1.5).otherwise(F.lit(1.0)) if logistic else None
    model = boosting.fit(df, "y", option, logistic=logistic, weight=weight)
    rows = df.orderBy("id").collect()
    cells = [np.array([math.nan if r[c] is None else r[c] for r in rows]) for c in COLS]
    bins = boosting.binned(cells, model.edges)
    y = np.array([r["y"] for r in rows])
    w = np.where(y == 1, 1.5, 1.0) if logistic else np.ones(len(y))
    mean = (w * y).sum() / w.sum()
    base = math.log(mean / (1 - mean)) if logistic else mean
    assert model.base == pytest.approx(base)
    margin = np.full(len(y), base)
    for tree in model.trees:
        g, h = boosting.derivatives(margin, y, w, logistic)
        splits, leaves = plain_tree(bins.tolist(), g.tolist(), h.tolist(), option, range(len(COLS)))
        assert {int(n): (int(tree.feature[n]), int(tree.cut[n])) for n in np.flatnonzero(tree.feature >= 0)} == {n: s[:2] for n, s in splits.items()}
        for node, value in leaves.items():
            assert tree.value[node] == pytest.approx(value, abs=1e-5)
        margin = margin + tree.values(bins)
    got = [r[0] for r in df.orderBy("id").select(model.margin()).collect()]
    assert got == pytest.approx(margin.tolist())


def test_edges_are_quantiles_however_rows_are_spread(spark):
    draw = random.Random(6)
    rows = [(draw.gauss(0, 100), float(draw.randint(-3, 4)), None if i % 3 else -1.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 double")
    first, second, third = boosting.quantile_edges(df.repartition(5), 3)
    for one, other in zip((first, second, third), boosting.quantile_edges(df.coalesce(1), 3), strict=True):
        assert one.tolist() == other.tolist()
    assert second == pytest.approx([-2, -1, 0, 1, 2, 3, 4], rel=1e-3) and (second <= [-2, -1, 0, 1, 2, 3, 4]).all() and third.tolist() == []
    assert 200 < len(first) <= 254
    sizes = np.bincount(np.searchsorted(first, [r[0] for r in rows], side="right"))
    assert sizes.max() < 3 * 3000 / 255


def test_fits_side_by_side_equal_single_fits_however_rows_are_spread(spark, some):
    options = [Options(COLS, 25, 3, rate=0.1), Options(("c", "a"), 12, 2, 8.0, 0.2, seed=7), Options(("b",), 3, 4, rows=1.0, columns=1.0)]
    together = boosting.fit_all(some, "y", options)
    for option, model in zip(options, together, strict=True):
        # rows are drawn by the hash of all fitted columns, so the columns go along
        alone = boosting.fit_all(table(spark, parts=1), "y", [Options(COLS, rounds=0), option])[1]
        assert len(model.trees) == option.rounds
        for one, other in zip(model.trees, alone.trees, strict=True):
            assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and one.value == pytest.approx(other.value)


def test_held_out_error_no_worse_than_first_order_trees(spark):
    train, test = table(spark, 600, 1), table(spark, 300, 2).fillna(0.0)
    train = train.fillna(0.0)
    model = boosting.fit(train, "y", Options(COLS, 60, 4, rate=0.1))
    own = model.transform(test).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    vectors = VectorAssembler(inputCols=list(COLS), outputCol="features")
    other = GBTRegressor(labelCol="y", maxIter=60, maxDepth=4, stepSize=0.1, minInstancesPerNode=5, subsamplingRate=0.8, seed=42).fit(vectors.transform(train))
    theirs = other.transform(vectors.transform(test)).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert own <= theirs * 1.05


def test_validation_error_and_patience(spark):
    train, held = table(spark, 200, 1), table(spark, 100, 9)
    model = boosting.fit(train, "y", Options(COLS, 200, 4, rate=0.5, patience=8), held=held)
    assert len(model.trees) < 200 and len(model.curve) == len(model.trees)
    assert len(model.curve) - 1 - model.best_iteration == 8
    for trees in (1, len(model.trees)):
        mae = model.transform(held, trees).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
        assert mae == pytest.approx(model.curve[trees - 1])
    best = model.transform(held).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert best == pytest.approx(min(model.curve))


def test_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, None, float(i % 2)) for i in range(40)], "a double, b double, y double")
    model = boosting.fit(df, "y", Options(("a", "b"), 3, 2))
    assert all((t.feature < 0).all() for t in model.trees)
    assert model.transform(df).agg(F.min("prediction"), F.max("prediction")).first() == (0.5, 0.5)
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(df.limit(0), "y", Options(("a",), 1, 1))
    one = boosting.fit(df.filter("y = 1"), "y", Options(("a",), 2, 1), logistic=True)
    assert one.transform(df).count() == 40


def test_importances_are_shares_of_mean_gain(spark, some):
    model = boosting.fit(some, "y", Options(COLS, 5, 3))
    shares = model.importances()
    assert sum(shares.values()) == pytest.approx(1.0) and list(shares) == list(COLS)


def test_defaults_are_full_rounds():
    option = demand.tree_options()
    assert (option.rounds, option.depth, option.rate, option.child_weight, option.l2, option.rows, option.columns) == (500, 5, 0.03, 5, 1.0, 0.8, 0.8)


def test_classifier_weighs_positives(spark):
    draw = random.Random(2)
    rows = [(draw.gauss(2 * (i % 10 == 0), 1), draw.gauss(0, 1), int(i % 10 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    model = models.fit_tree_classifier(df, ["a", "b"], "y", rounds=30)
    assert model.base == pytest.approx(0.0)
    out = models.scored(model, df, "p")
    assert out.columns == ["a", "b", "y", "p"]
    mean = dict(out.groupBy("y").agg(F.avg("p")).collect())
    assert mean[1] > 0.6 > 0.4 > mean[0]


def test_early_stopping_reads_every_patience_from_one_curve(spark):
    import datetime as dt

    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), int(20 + 8 * math.sin(i / 3) + (i * 7919) % 5)) for i in range(200)]
    table = demand.demand_features(spark.createDataFrame(rows, "series string, date date, order_count int"), "series")
    train, valid = table.filter("time_index < 150"), table.filter("time_index >= 150")
    out = demand.early_stopping(train, valid, (2, 5), rounds=40, rate=0.3).collect()
    assert [r["early_stopping_rounds"] for r in out] == [2, 5]
    assert out[0]["best_score"] >= out[1]["best_score"] and all(r["validation_mae"] <= r["best_score"] + 1e-9 for r in out)
    swept = demand.sweep({"small": {"rounds": 3, "depth": 2}, "lags": {"rounds": 5, "features": demand.LAG_FEATURES}}, train, valid).collect()
    assert {(r["experiment"], r["feature_count"], r["trees"]) for r in swept} == {("small", 26, 3), ("lags", 7, 5)}


def test_driver_gets_splits_and_not_sums(spark, monkeypatch):
    import pickle

    from pyspark import RDD

    draw = random.Random(5)
    rows = [(draw.gauss(0, 1), draw.gauss(0, 1), draw.random()) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    sizes, collect = [], RDD.collect

    def measured(self):
        out = collect(self)
        sizes.append(len(pickle.dumps(out)))
        return out

    monkeypatch.setattr(RDD, "collect", measured)
    model = boosting.fit(df, "y", Options(("a", "b"), 2, 4, 1.0))
    assert len(model.edges[0]) > 200 and len(sizes) >= 8 and max(sizes) < 3000


def test_columns_in_groups_give_the_splits_of_all(spark, monkeypatch):
    df = table(spark).select("y", *[(F.col(c) * (k % 3 + 1)).alias(f"{c}{k}") for k in range(3) for c in COLS])
    option = Options(tuple(df.columns[1:]), 3, 3, 3.0, columns=1.0)
    grouped = boosting.fit(df, "y", option)
    monkeypatch.setattr(boosting, "GROUP", 100)
    whole = boosting.fit(df, "y", option)
    for one, other in zip(grouped.trees, whole.trees, strict=True):
        assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and (one.value == other.value).all()


def test_places_follow_each_row_from_the_root():
    draw = np.random.default_rng(4)
    for depth in (1, 3, 8):
        tree = boosting.Tree.root(depth)
        for at in range(2**depth - 1):
            if (at == 0 or tree.feature[(at - 1) // 2] >= 0) and draw.random() < 0.9:
                tree.feature[at], tree.cut[at], tree.missing_left[at] = draw.integers(3), draw.integers(254), draw.random() < 0.5
        bins = draw.integers(0, 256, (200, 3)).astype(np.uint8)
        for row, got in zip(bins, tree.places(bins), strict=True):
            at = 0
            while tree.feature[at] >= 0:
                b = row[tree.feature[at]]
                at = 2 * at + 1 + (not tree.missing_left[at] if b == MISSING else b > tree.cut[at])
            assert got == at
