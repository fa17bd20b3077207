import random

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from basketry.plans import clustering, models, voc
from basketry.plans.clustering import Start
from basketry.session import discard


def cloud(n=400, dims=3, groups=5, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 6, (groups, dims))[rng.integers(0, groups, n)] + rng.normal(0, 1, (n, dims))


@pytest.fixture(scope="module")
def points(spark):
    x = cloud()
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "n int, v array<double>").repartition(3)
    table = clustering.with_points(df, F.col("v"))
    yield x, df, table
    discard(table)


def lloyd(x, centres, iterations=50, tolerance=1e-4):
    for _ in range(iterations):
        label = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        moved = np.array([x[label == k].mean(0) if (label == k).any() else c for k, c in enumerate(centres)])
        done = ((moved - centres) ** 2).sum(1).max() <= tolerance**2
        centres = moved
        if done:
            break
    return centres, ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_many_fits_equal_plain_fits_from_the_same_starts(points):
    x, _, table = points
    rng = np.random.default_rng(5)
    starts = [Start(k, s, dims) for k in (2, 3, 5) for s in range(3) for dims in (None, (0, 2))]
    first = [x[rng.choice(len(x), s.k, replace=False)][:, list(s.dims or (0, 1, 2))] for s in starts]
    fits = clustering.fit_starts(table, starts, first=first)
    for f, s, c in zip(fits, starts, first, strict=True):
        own = x if s.dims is None else x[:, s.dims]
        centres, inertia = lloyd(own, c)
        assert f.centres == pytest.approx(centres) and f.inertia == pytest.approx(inertia)
        assert f.sizes.sum() == len(x)


def test_jobs_do_not_grow_with_starts(spark, points):
    _, _, table = points

    def jobs(starts):
        tracker, group = spark.sparkContext.statusTracker(), f"kmeans-{len(starts)}"
        spark.sparkContext.setJobGroup(group, group)
        clustering.fit_starts(table, starts, max_iter=2, tolerance=0.0)
        spark.sparkContext.setJobGroup("other", "other")
        return len(tracker.getJobIdsForGroup(group))

    assert jobs([Start(3, s) for s in range(12)]) == jobs([Start(3, 0)])


def test_points_of_few_files_are_dealt_over_all_cores(spark):
    df = spark.createDataFrame([(r,) for r in cloud(4000).tolist()], "v array<double>").coalesce(1)
    table = clustering.with_points(df, F.col("v"))
    sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)
    discard(table)


def test_sums_of_equally_near_centres_go_to_the_first():
    x = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [5.0, 1.0]])
    centres = np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 0.0]])
    got = clustering._cluster_sums(clustering.Points(x, np.arange(4)), centres)
    assert got.tolist() == [[2, 1, 1, 1, 0], [2, 10, 30, 7, 1], [0, 0, 0, 0, 0]]


def test_starts_find_the_groups(points):
    x, _, table = points
    fits = clustering.fit_starts(table, [Start(5, s) for s in range(10)])
    rng = np.random.default_rng(0)
    want = min(lloyd(x, x[rng.choice(len(x), 5, replace=False)])[1] for _ in range(30))
    assert min(f.inertia for f in fits) <= want * 1.001
    again = clustering.fit_starts(table, [Start(5, 3)])[0]
    assert again.centres == pytest.approx(fits[3].centres)


def test_silhouettes_equal_the_evaluator(points):
    _, df, table = points
    fits = clustering.fit_starts(table, [Start(k, 1) for k in (2, 4, 6)])
    for f, got in zip(fits, clustering.silhouettes(table, fits), strict=True):
        scored = df.select(array_to_vector("v").alias("features"), f.label(F.col("v")).alias("prediction"))
        assert got == pytest.approx(ClusteringEvaluator().evaluate(scored))


def test_fewer_points_than_clusters_and_equal_points(spark):
    df = spark.createDataFrame([([1.0, 2.0],)] * 20 + [([3.0, 4.0],)] + [(None,), ([None, 1.0],), ([float("nan"), 1.0],)], "v array<double>")
    (fit,), (score,) = clustering.best_of(df, F.col("v"), [Start(4, s) for s in range(3)])
    assert fit.inertia == pytest.approx(0) and sorted(fit.sizes) == [1, 20] and score == pytest.approx(20 / 21)
    with pytest.raises(ValueError, match="no points"):
        clustering.best_of(df.limit(0), F.col("v"), [Start(2, 1)])


def test_sweep_stability_and_themes(spark):
    draw = random.Random(4)
    rows = [(f"c{i}", draw.gauss(8 * (i % 4), 1), draw.gauss(8 * (i % 2), 1), draw.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double").repartition(2)
    table = {(r["feature_space"], r["k"]): r for r in models.kmeans_sweep(df, {"ab": ["a", "b"], "ac": ["a", "c"]}, (2, 3, 4), range(6)).collect()}
    assert set(table) == {(n, k) for n in ("ab", "ac") for k in (2, 3, 4)}
    model, _ = models.fit_kmeans(df, ["a", "b"], 4, range(6))
    assert table["ab", 4]["inertia"] == pytest.approx(model.inertia) and table["ab", 4]["silhouette"] > 0.8
    pairs = models.cluster_stability(df, ["a", "b"], "id", 4, (1, 50, 99), 6).collect()
    assert len(pairs) == 3 and all(r["adjusted_rand"] == pytest.approx(1.0) for r in pairs)
    vectors = spark.createDataFrame([(i, r) for i, r in enumerate(cloud(200, 4, 3).tolist())], "i int, v array<float>")
    labelled, results = voc.discover_themes(vectors, "v", (2, 3, 4), starts=4)
    assert labelled.columns == ["i", "v", "semantic_theme_cluster"] and results.count() == 3
    best = results.orderBy(F.desc("silhouette")).first()
    sizes = [r["count"] for r in labelled.groupBy("semantic_theme_cluster").count().collect()]
    assert (len(sizes), min(sizes), max(sizes)) == (best["k"], best["smallest_cluster"], best["largest_cluster"])
