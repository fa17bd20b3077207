import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.plans import logistic, metrics, models, reviews, voc
from basketry.session import scratch_path

BOTH_WAYS = pytest.mark.parametrize("limit", [10**6, 1], ids=["windowed", "ranged"])


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(11)
    data = [(i, round(rng.random(), 2), int(rng.random() < 0.3)) for i in range(300)]
    return data, spark.createDataFrame(data, "id int, p double, y int").repartition(4).cache()


@BOTH_WAYS
def test_auc_against_pairs(scores, limit):
    data, df = scores
    pos, neg = [p for _, p, y in data if y], [p for _, p, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, "p", "y", group_rows=limit).first().roc_auc == pytest.approx(want)


@BOTH_WAYS
def test_average_precision_against_thresholds(scores, limit):
    data, df = scores
    total, last, want = sum(y for *_, y in data), 0, 0.0
    for cut in sorted({p for _, p, _ in data}, reverse=True):
        chosen = [y for _, p, y in data if p >= cut]
        want += (sum(chosen) - last) / total * sum(chosen) / len(chosen)
        last = sum(chosen)
    assert metrics.average_precision(df, "p", "y", group_rows=limit).first().average_precision == pytest.approx(want)


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(spark.createDataFrame([(0.1, 1)], "p double, y int"), "p", "y").first().roc_auc is None


def test_calibration_bins(scores):
    data, df = scores
    edges = np.percentile([p for _, p, _ in data], np.linspace(0, 100, 6))
    bins = np.searchsorted(edges[1:-1], [p for _, p, _ in data])
    want = [np.mean([p for (_, p, _), b in zip(data, bins) if b == k]) for k in sorted(set(bins))]
    got = [r.mean_predicted_probability for r in metrics.calibration(df, "p", "y", 5).orderBy("bin").collect()]
    assert got == pytest.approx(want)


def test_recall_grows_with_capacity(scores):
    _, df = scores
    table = metrics.lift_table(df, "p", "y", "id", [0.01, 0.1, 0.5, 1.0]).orderBy("capacity").collect()
    assert [r.targeted for r in table] == [3, 30, 150, 300]
    recalls = [r.recall for r in table]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0 and table[-1].lift == pytest.approx(1.0)


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(i % 3, (i % 3 + 1) % 3, 0) for i in range(30)], "a int, b int, c int")
    assert metrics.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(1.0)
    assert metrics.adjusted_rand(df, "a", "c").first()[0] == pytest.approx(0.0)


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(5)
    data = []
    for i in range(200):
        y = i % 2
        data.append((f"c{i}", rng.gauss(4 * y, 1), rng.gauss(0, 1), 1.0, y))
    return spark.createDataFrame(data, "id string, a double, b double, flat double, y int").repartition(2).cache()


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_survives_a_round_trip(separable, balanced):
    model = models.fit_logistic(separable, ["a", "b", "flat"], "y", balanced=balanced, max_iter=30)
    path = scratch_path(separable.sparkSession, "model")
    models.save_model(model, path)
    first = models.scored(model, separable, "p")
    again = models.scored(models.load_model(path), separable, "p")
    assert sorted(r.p for r in first.collect()) == sorted(r.p for r in again.collect())
    assert metrics.roc_auc(first, "p", "y").first().roc_auc > 0.99
    assert first.filter(~F.col("p").between(0, 1)).count() == 0


@pytest.fixture(scope="module")
def stretches(spark):
    """Rows of customers that differ in their age alone for a while, a constant column, and overlapping classes."""
    rng, data = random.Random(8), []
    for who in range(120):
        a, b = rng.gauss(0, 1), float(rng.randint(0, 5))
        for age in range(rng.randint(1, 9)):
            data.append((a, 30.5 * age + rng.random(), b, 0.1, int(rng.random() < 1 / (1 + math.exp(1.5 - a)))))
    return spark.createDataFrame(data, "a double, age double, b double, flat double, y int").coalesce(3).cache()


def test_packed_logistic_is_sparks(stretches, monkeypatch):
    """Fits with other columns and weights share their passes, and every one is Spark's own."""
    fits = [(["a", "age", "b", "flat"], True), (["a", "age", "b", "flat"], False), (["b", "a"], True)]
    want = models.fit_logistics(stretches, fits, "y")
    alone, passes, evaluate = [], [], logistic.Blocks.evaluate
    monkeypatch.setattr(logistic.Blocks, "evaluate", lambda self, centre, points: passes.append(len(points)) or evaluate(self, centre, points))
    for cols, balanced in fits:
        passes.clear()
        models.fit_logistic(stretches, cols, "y", balanced, spark_rows=0)
        alone.append(len(passes))
    passes.clear()
    got = models.fit_logistics(stretches, fits, "y", spark_rows=0)
    assert len(passes) == max(alone) and passes[0] == 3
    for a, b in zip(want, got, strict=True):
        assert b.stages[2].coefficients.toArray() == pytest.approx(a.stages[2].coefficients.toArray(), rel=1e-5, abs=1e-9)
        assert b.stages[2].intercept == pytest.approx(a.stages[2].intercept, rel=1e-5)
        p, q = (sorted(r[0] for r in models.scored(m, stretches, "p").select("p").collect()) for m in (a, b))
        assert q == pytest.approx(p, rel=1e-5)


def test_packed_logistic_leaves_odd_rows_to_spark(stretches):
    one_class = models.fit_logistic(stretches.filter("y = 0"), ["a"], "y", spark_rows=0)
    assert one_class.stages[2].intercept == -math.inf
    with pytest.raises(Exception, match="null|NaN"):
        models.fit_logistic(stretches.withColumn("a", F.when(F.col("b") > 0, F.col("a"))), ["a"], "y", spark_rows=0)


def test_runs_hold_the_rows():
    rng = np.random.default_rng(4)
    common = np.repeat(rng.integers(0, 3, (3, 40)).astype(float), rng.integers(1, 9, 40), axis=1)
    columns = np.insert(common, 1, rng.random(common.shape[1]), axis=0)
    labels = (columns[0] > 1).astype(float)
    runs = logistic.runs_of(columns, labels)
    assert runs.free == 1 and len(runs.lengths) <= 40 and np.array_equal(runs.values, columns[1])
    again = np.repeat(runs.common, runs.lengths, axis=1)
    again[1] = runs.values
    assert np.array_equal(again, columns) and np.array_equal(np.repeat(runs.labels, runs.lengths), labels)
    facts = logistic.moments(runs)
    for y in (0, 1):
        own = columns[:, labels == y]
        assert facts[y, 0] == own.shape[1] and facts[y, 1:5] == pytest.approx(own.mean(1)) and facts[y, 5:] == pytest.approx(own.var(1) * own.shape[1])


def test_kmeans_cost_is_the_within_cluster_sum(separable):
    model, labelled = models.fit_kmeans(separable, ["a", "b"], 2, seeds=(1, 2))
    scaled = models.standardize(labelled, ["a", "b"])
    centres = scaled.groupBy("cluster_id").agg(F.avg("z_a").alias("ca"), F.avg("z_b").alias("cb"))
    cost = scaled.join(centres, "cluster_id").agg(F.sum(F.pow(F.col("z_a") - F.col("ca"), 2) + F.pow(F.col("z_b") - F.col("cb"), 2))).first()[0]
    assert labelled.count() == 200 and cost == pytest.approx(model.summary.trainingCost, rel=1e-3)


DOCS = [(1, "um bom produto bom"), (2, "bom produto"), (3, "produto ruim"), (4, "nada aqui")]


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame(DOCS, "id int, text string")
    got = {(r.id, r.term): r.weight for r in reviews.tfidf(docs, "id", "text").collect()}
    idf = {"bom": math.log(5 / 3) + 1, "produto": math.log(5 / 4) + 1, "bom produto": math.log(5 / 3) + 1}
    raw = {(1, "bom"): (1 + math.log(2)) * idf["bom"], (1, "produto"): idf["produto"], (1, "bom produto"): idf["bom produto"],
           (2, "bom"): idf["bom"], (2, "produto"): idf["produto"], (2, "bom produto"): idf["bom produto"], (3, "produto"): idf["produto"]}
    norms = {d: math.sqrt(sum(w * w for (k, _), w in raw.items() if k == d)) for d in (1, 2, 3)}
    assert got.keys() == raw.keys()
    assert all(got[k] == pytest.approx(w / norms[k[0]]) for k, w in raw.items())


def test_tfidf_partitions_follow_the_texts(spark, monkeypatch):
    """What a task holds is set by the bytes of text and not by the session's number of shuffle partitions; frequent terms and the others weigh the same."""
    docs = spark.createDataFrame([*((i, f"um produto w{i % 7} x{i} um") for i in range(60)), (None, "um w1 w2"), (70, None)], "id int, text string")
    want = {(r.id, r.term): r.weight for r in reviews.tfidf(docs, "id", "text", max_terms=None).collect()}
    monkeypatch.setattr(reviews, "PART_BYTES", 64)
    monkeypatch.setattr(reviews, "FREQUENT", 3)
    weights = reviews.tfidf(docs, "id", "text", max_terms=None)
    assert weights.rdd.getNumPartitions() == reviews.text_parts(docs, "text")[1] > 10
    got = {(r.id, r.term): r.weight for r in weights.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(w) for k, w in want.items()) and (None, "w1") in got
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_text_classifier_learns_words(spark):
    docs = spark.createDataFrame([(i, "muito bom produto" if i % 2 else "produto ruim demais", "pos" if i % 2 else "neg") for i in range(40)], "id int, text string, label string")
    model = reviews.fit_text_classifier(docs, "id", "text", "label", ["neg", "pos"], max_iter=10)
    out = model.predict(docs.unionByName(spark.createDataFrame([(99, "xyz", "neg")], docs.schema)), "id", "text")
    assert out.count() == 41
    assert out.filter("id < 40 and label <> predicted_class").count() == 0


def test_representatives_by_brute_force(spark):
    rng = np.random.default_rng(2)
    data = [(i, i % 2, [float(v) for v in rng.normal(size=4)]) for i in range(40)]
    df = spark.createDataFrame(data, "id int, c int, v array<double>")
    got = {}
    for r in voc.representatives(df, "v", "c", "id", 5).collect():
        got.setdefault(r.c, {})[r["rank"]] = r.id
    for c in (0, 1):
        rows = [(i, np.array(v)) for i, k, v in data if k == c]
        centre = np.mean([v for _, v in rows], axis=0)
        near = sorted(rows, key=lambda r: 1 - r[1] @ centre / np.linalg.norm(r[1]) / np.linalg.norm(centre))[:5]
        assert [got[c][k] for k in range(1, 6)] == [i for i, _ in near]


def test_a_zero_vector_is_no_representative_before_others(spark):
    from basketry.plans import voc

    df = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 1.0], "a"), (3, [2.0, 1.0], "a")], "id int, v array<double>, c string")
    got = [(r["id"], round(r["distance_to_centroid"], 6)) for r in voc.representatives(df, "v", "c", "id").orderBy("distance_to_centroid").collect()]
    assert got[-1] == (1, 1.0) and got[0][1] < 0.1


def test_embedding_scaling_is_by_the_population_deviation(spark):
    from basketry.plans import reviews

    rows = [(float(i % 5), float(i), i % 2) for i in range(20)]
    df = spark.createDataFrame([([a, b], y) for a, b, y in rows], "v array<double>, y int")
    model = reviews.fit_embedding_classifier(df, "v", "y")
    got = model.transform(reviews.embedding_vectors(df, "v")).select("features").collect()
    for k in range(2):
        assert abs(sum(r["features"][k] ** 2 for r in got) / 20 - 1) < 1e-9


def test_term_counts_and_vectors_with_repeated_and_missing_ids(spark):
    """Texts under one id are one document, texts without id count as one and get no vector, and no term is shuffled by its document."""
    docs = spark.createDataFrame([(1, "um bom produto bom"), (1, "bom nada"), (2, "bom produto"), (3, ""), (4, None), (None, "um bom"), (None, "um ruim")], "id int, text string")
    counts = reviews.term_counts(docs, "id", "text")
    got = {(r.id, r.term): r.tf for r in counts.collect()}
    assert got == {
        (1, "um"): 1, (1, "bom"): 3, (1, "produto"): 1, (1, "nada"): 1, (1, "um bom"): 1, (1, "bom produto"): 1, (1, "produto bom"): 1, (1, "bom nada"): 1,
        (2, "bom"): 1, (2, "produto"): 1, (2, "bom produto"): 1, (None, "um"): 2, (None, "bom"): 1, (None, "um bom"): 1, (None, "ruim"): 1, (None, "um ruim"): 1,
    }
    vectors = reviews.term_vectors(docs, "id", "text", [("bom", 2.0), ("produto", 1.0)])
    out = [(r.id, r.features.toArray().tolist()) for r in vectors.collect()]
    first = np.array([2 * (1 + math.log(3)), 1.0])
    assert sorted(v for k, v in out if k == 1) == [pytest.approx((first / np.linalg.norm(first)).tolist())] * 2
    assert [v for k, v in out if k == 2] == [pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5)])]
    assert [v for k, v in out if k not in (1, 2)] == [[0.0, 0.0]] * 4
    plan = vectors._sc._jvm.PythonSQLUtils.explainString(vectors._jdf.queryExecution(), "formatted")
    assert "Window" not in plan and "Generate" not in plan
