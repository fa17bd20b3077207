"""Clustering, classification, evaluation of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.catalog import query
from basketry.plans import metrics as m
from basketry.plans import models, rfm
from basketry.plans import retention as r
from basketry.session import scratch_path

P, Y, ID, T = "repeat_purchase_probability", "repeat_purchase_90d", "customer_unique_id", "snapshot_timestamp"


def _r(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("standardize", "M1", """
    SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 8) AS z_c_acctbal,
      round((c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER (), 8) AS z_c_nationkey FROM customer""")
def standardize(x):
    df = models.standardize(x["customer"], ["c_acctbal", "c_nationkey"])
    return _r(df.select("c_custkey", "z_c_acctbal", "z_c_nationkey"), "z_c_acctbal", "z_c_nationkey", digits=8)


@query("impute_median", "M8", """
    SELECT order_id, coalesce(delivery_delay_days::DOUBLE, (SELECT median(delivery_delay_days) FROM o_staged)) AS delivery_delay_days FROM o_staged""")
def impute_median(x):
    return models.impute_median(x.staged_orders.select("order_id", "delivery_delay_days"), ["delivery_delay_days"])


AUC = """
    SELECT snapshot_timestamp, round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 9) AS roc_auc FROM (
      SELECT snapshot_timestamp, p, n, coalesce(sum(n) OVER (PARTITION BY snapshot_timestamp ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
        SELECT snapshot_timestamp, repeat_purchase_probability AS s, count(*) FILTER (repeat_purchase_90d = 1) AS p, count(*) FILTER (repeat_purchase_90d = 0) AS n
        FROM x_scored GROUP BY 1, 2)) GROUP BY 1"""
AP = """
    SELECT snapshot_timestamp, round(sum(p * tp / "all") / sum(p), 9) AS average_precision FROM (
      SELECT snapshot_timestamp, p::DOUBLE AS p, sum(p) OVER w AS tp, sum(p + n) OVER w AS "all" FROM (
        SELECT snapshot_timestamp, repeat_purchase_probability AS s, count(*) FILTER (repeat_purchase_90d = 1) AS p, count(*) FILTER (repeat_purchase_90d = 0) AS n
        FROM x_scored GROUP BY 1, 2) WINDOW w AS (PARTITION BY snapshot_timestamp ORDER BY s DESC)) GROUP BY 1"""


@query("roc_auc", "M12", AUC)
def roc_auc(x):
    return _r(m.roc_auc(x["x_scored"], P, Y, T), "roc_auc")


@query("roc_auc_pairs", "M12", """
    SELECT round(sum(CASE WHEN a.s > b.s THEN a.n * b.n WHEN a.s = b.s THEN a.n * b.n / 2.0 ELSE 0 END) / sum(a.n * b.n), 9) AS roc_auc
    FROM (SELECT repeat_purchase_probability AS s, count(*) AS n FROM x_scored WHERE repeat_purchase_90d = 1 GROUP BY 1) a
    CROSS JOIN (SELECT repeat_purchase_probability AS s, count(*) AS n FROM x_scored WHERE repeat_purchase_90d = 0 GROUP BY 1) b""")
def roc_auc_pairs(x):
    """The same measure against its definition: every positive with every negative."""
    return _r(m.roc_auc(x["x_scored"], P, Y), "roc_auc")


@query("roc_auc_ranged", "M12", AUC)
def roc_auc_ranged(x):
    return _r(m.roc_auc(x["x_scored"], P, Y, T, group_rows=1), "roc_auc")


@query("average_precision", "M13", AP)
def average_precision(x):
    return _r(m.average_precision(x["x_scored"], P, Y, T), "average_precision")


@query("brier_score", "M14", """
    SELECT snapshot_timestamp, round(avg(pow(repeat_purchase_probability - repeat_purchase_90d, 2)), 9) AS brier_score FROM x_scored GROUP BY 1""")
def brier_score(x):
    return _r(m.brier(x["x_scored"], P, Y, T), "brier_score")


def _calibration(bins: int, key: str) -> str:
    inner = ", ".join(str(i / bins) for i in range(1, bins))
    return f"""
    SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY b) AS bin, rows, round(mp, 9) AS mean_predicted_probability, round(obs, 9) AS observed_positive_rate,
      round(abs(mp - obs), 9) AS absolute_gap FROM (
      SELECT {key}, b, count(*) AS rows, avg(repeat_purchase_probability) AS mp, avg(repeat_purchase_90d) AS obs FROM (
        SELECT s.*, len(list_filter(e, lambda v: v < repeat_purchase_probability)) AS b FROM (SELECT *, strftime(snapshot_timestamp, '%Y-%m') AS month FROM x_scored) s
        JOIN (SELECT {key}, quantile_cont(repeat_purchase_probability, [{inner}]) AS e FROM (SELECT *, strftime(snapshot_timestamp, '%Y-%m') AS month FROM x_scored) GROUP BY 1) q
          ON q.{key} = s.{key}) GROUP BY 1, 2)"""


@query("calibration", "M15", _calibration(10, "snapshot_timestamp"))
def calibration(x):
    return _r(m.calibration(x["x_scored"], P, Y, 10, T), "mean_predicted_probability", "observed_positive_rate", "absolute_gap")


def _lift(key: str, capacities) -> str:
    listed = ", ".join(map(str, capacities))
    return f"""
    SELECT *, total_positive::DOUBLE / population AS baseline_positive_rate, captured::DOUBLE / targeted AS precision, captured::DOUBLE / total_positive AS recall,
      (captured::DOUBLE / targeted) / (total_positive::DOUBLE / population) AS lift FROM (
      SELECT {key}, n AS population, pos AS total_positive, c AS capacity, greatest(1, floor(n * c))::BIGINT AS targeted,
        count(*) FILTER (rk <= greatest(1, floor(n * c)) AND repeat_purchase_90d = 1) AS captured
      FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY repeat_purchase_probability DESC, customer_unique_id) AS rk,
          count(*) OVER (PARTITION BY {key}) AS n, sum(repeat_purchase_90d) OVER (PARTITION BY {key})::BIGINT AS pos FROM x_scored)
      CROSS JOIN (SELECT unnest([{listed}])::DOUBLE AS c) GROUP BY ALL)"""


@query("lift_table", "M16 F5", _lift("snapshot_timestamp", m.CAPACITIES))
def lift_table(x):
    return m.lift_table(x["x_scored"], P, Y, ID, by=T)


@query("monthly_stability", "M17", f"""
    WITH s AS (SELECT *, strftime(snapshot_timestamp, '%Y-%m') AS month FROM x_scored)
    SELECT b.month, b.rows, b.positive_count, b.positive_rate, a.roc_auc, p.average_precision, b.brier_score, c.mean_absolute_calibration_gap FROM (
      SELECT month, count(*) AS rows, sum(repeat_purchase_90d)::BIGINT AS positive_count, avg(repeat_purchase_90d) AS positive_rate,
        round(avg(pow(repeat_purchase_probability - repeat_purchase_90d, 2)), 9) AS brier_score FROM s GROUP BY 1) b
    JOIN ({AUC.replace("snapshot_timestamp", "month").replace("x_scored", "s")}) a USING (month) JOIN ({AP.replace("snapshot_timestamp", "month").replace("x_scored", "s")}) p USING (month)
    JOIN (SELECT month, round(avg(absolute_gap), 8) AS mean_absolute_calibration_gap FROM ({_calibration(5, "month")}) GROUP BY 1) c USING (month)
    WHERE positive_count BETWEEN 1 AND rows - 1""")
def monthly_stability(x):
    df = m.stability_by_month(x["x_scored"], P, Y, T)
    return _r(_r(df, "roc_auc", "average_precision", "brier_score"), "mean_absolute_calibration_gap", digits=8)


@query("compare_rankings", "M18 E8 G2 G4", """
    WITH r AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY a DESC, c_custkey) AS ra, row_number() OVER (ORDER BY b DESC, c_custkey) AS rb, count(*) OVER () AS n
      FROM (SELECT c_custkey, c_acctbal AS a, c_acctbal * (1 + c_custkey % 3) AS b FROM customer))
    SELECT (SELECT round(corr(ra, rb), 9) FROM r) AS spearman, c AS capacity, k AS n, o AS overlap_count, u AS union_count, o::DOUBLE / k AS overlap_rate, o::DOUBLE / u AS jaccard_similarity
    FROM (SELECT c, greatest(1, floor(n * c))::BIGINT AS k, count(*) FILTER (ra <= greatest(1, floor(n * c)) AND rb <= greatest(1, floor(n * c))) AS o,
        count(*) FILTER (ra <= greatest(1, floor(n * c)) OR rb <= greatest(1, floor(n * c))) AS u
      FROM r CROSS JOIN (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2])::DOUBLE AS c) GROUP BY 1, 2)""")
def compare_rankings(x):
    df = x["customer"].select("c_custkey", F.col("c_acctbal").alias("a"), (F.col("c_acctbal") * (1 + F.col("c_custkey") % 3)).alias("b"))
    return _r(m.compare_rankings(df, "a", "b", "c_custkey"), "spearman")


@query("score_distribution", "M18 D8", f"""
    SELECT 'repeat_purchase_probability' AS "column", count({P}) AS count, round(avg({P}), 9) AS mean, round(stddev_samp({P}), 9) AS std, min({P}) AS min,
      {", ".join(f"round(quantile_cont({P}, {p}), 9) AS {n}" for n, p in (("p01", 0.01), ("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))}, max({P}) AS max FROM x_scored""")
def score_distribution(x):
    return _r(m.score_distribution(x["x_scored"], [P]), "mean", "std", "p01", "p05", "p50", "p95", "p99")


@query("confusion_matrix", "M20", """
    SELECT quality AS label, toxic AS prediction, count(*) AS rows FROM labels GROUP BY 1, 2""")
def confusion_matrix(x):
    return m.confusion(x["labels"], "quality", "toxic")


@query("classification_report", "M20", """
    WITH p AS (SELECT review_score AS y, 1 + (review_observation_id % 5)::INTEGER AS g FROM x_reviews),
    c AS (SELECT k AS class, count(*) FILTER (y = k) AS support, count(*) FILTER (g = k) AS guessed, count(*) FILTER (y = k AND g = k) AS hit
      FROM p CROSS JOIN (SELECT DISTINCT unnest([y, g]) AS k FROM p) GROUP BY 1),
    s AS (SELECT class::VARCHAR AS class, coalesce(hit::DOUBLE / nullif(guessed, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall,
      coalesce(2.0::DOUBLE * hit / nullif(guessed + support, 0), 0) AS f1, support, hit FROM c),
    a AS (SELECT class, precision, recall, f1, support FROM s UNION ALL
      SELECT 'accuracy', sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support), sum(support) FROM s UNION ALL
      SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s UNION ALL
      SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s)
    SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM a""")
def classification_report(x):
    df = x["x_reviews"].select(F.col("review_score").alias("y"), (1 + F.col("review_observation_id") % 5).cast("int").alias("g"))
    return _r(m.classification_report(df, "y", "g"), "precision", "recall", "f1")


@query("adjusted_rand", "M7", """
    WITH t AS (SELECT label AS a, (vec_id % 4)::INTEGER AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS p,
      (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS q, (SELECT sum(n) * (sum(n) - 1) / 2 FROM t) AS e)
    SELECT round((x - p * q / e) / ((p + q) / 2 - p * q / e), 9) AS adjusted_rand FROM s""")
def adjusted_rand(x):
    df = x["embeddings"].withColumn("b", (F.col("vec_id") % 4).cast("int"))
    return _r(m.adjusted_rand(df, "label", "b"), "adjusted_rand")


# --- fitted models: rows only ---

SPACE = ["recency_days", "frequency", "monetary"]


def _clustering(x):
    return rfm.clustering_input(x.stored_rfm)


@query("kmeans_segments", "M3 M6")
def kmeans_segments(x):
    model, labelled = models.fit_kmeans(_clustering(x), SPACE, 4)
    stored = x.stored(labelled, "kmeans-segments")
    return rfm.customer_segments(stored, n_clusters=model.getK(), seed=model.getSeed())


@query("kmeans_sweep", "M4")
def kmeans_sweep(x):
    spaces = {"recency_days+frequency+monetary": SPACE, "recency_days+frequency+log_monetary": SPACE[:2] + ["log_monetary"]}
    return models.kmeans_sweep(_clustering(x), spaces)


@query("kmeans_profile", "M5")
def kmeans_profile(x):
    _, labelled = models.fit_kmeans(_clustering(x), SPACE, 3)
    return rfm.cluster_profile(x.stored(labelled, "kmeans-profile"), "cluster_id")


@query("kmeans_stability", "M7")
def kmeans_stability(x):
    return models.cluster_stability(_clustering(x), SPACE, "customer_unique_id")


def _splits(x):
    df = r.temporal_split(x.stored_training, T, "1999-12-31", "2000-09-30")
    return df.filter("split = 'train'"), df.filter("split = 'validation'"), df.filter("split = 'test'")


@query("logistic_scores", "M9 M21 O4")
def logistic_scores(x):
    """Fit, save, load and score the test population, then decide for one snapshot's requests."""
    from basketry.plans.decisions import prioritize

    train, _, test = _splits(x)
    path = scratch_path(x.spark, "logistic-model")
    models.save_model(models.fit_logistic(train, r.FEATURES, Y), path)
    scored = models.score_population(models.load_model(path), test, r.FEATURES)
    return prioritize(scored, 0.10, ID, P, by=T)


@query("class_weight_benchmark", "M9 M19")
def class_weight_benchmark(x):
    train, valid, test = _splits(x)
    both = models.fit_logistics(train, [(r.FEATURES, True), (r.FEATURES, False)], Y)
    fitted = dict(zip(("balanced_logistic", "unweighted_logistic"), both, strict=True))
    return models.benchmark_models(fitted, {"validation": valid, "test": test}, Y, ID)


@query("reduced_logistic", "M9 K9")
def reduced_logistic(x):
    train, _, test = _splits(x)
    model = models.fit_logistic(r.ratio_features(train), r.REDUCED_FEATURES, Y)
    scored = models.scored(model, r.ratio_features(test))
    return m.roc_auc(scored, P, Y, T).join(m.average_precision(scored, P, Y, T), T)


@query("second_feature_set", "M9 M19 K9")
def second_feature_set(x):
    """The second feature set and its reduced form, fitted and evaluated alike."""
    train, valid, test = (r.ratio_features(part) for part in _splits(x))
    fitted = dict(zip(("v2", "v2_reduced"), models.fit_logistics(train, [(r.V2_FEATURES, True), (r.REDUCED_FEATURES, True)], Y), strict=True))
    return models.benchmark_models(fitted, {"validation": valid, "test": test}, Y, ID)


@query("fitted_rankings", "M18 M9 G2 G4")
def fitted_rankings(x):
    """How alike a balanced and an unweighted model rank the test population."""
    train, _, test = _splits(x)
    balanced, unweighted = models.fit_logistics(train, [(r.FEATURES, True), (r.FEATURES, False)], Y)
    both = models.scored(unweighted, models.scored(balanced, test, "balanced"), "unweighted").select(ID, T, "balanced", "unweighted")
    return m.compare_rankings(x.stored(both, "two-scores"), "balanced", "unweighted", [ID, T])


@query("tree_classifier", "M10")
def tree_classifier(x):
    train, valid, _ = _splits(x)
    model = models.fit_tree_classifier(train, r.FEATURES, Y)
    return m.lift_table(models.scored(model, valid), P, Y, ID, (0.01, 0.02, 0.05, 0.10, 0.20))
