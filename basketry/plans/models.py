"""Clustering and classification on Spark ML, with scaling inside the saved model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.values import pct
from basketry.operators.joins import has_repeats_among
from basketry.operators.ordering import quantile_columns, with_group_total
from basketry.operators.topk import sort
from basketry.plans import boosting, clustering, logistic, metrics
from basketry.plans.boosting import BoostedTrees, Options
from basketry.plans.clustering import Centres, Start
from basketry.plans.retention import KEY, SNAPSHOT
from basketry.session import cut_lineage, discard

SCORE = "repeat_purchase_probability"
#: Where a logistic fit stops: fall of the loss over its last steps, as a share of the first loss.
TOLERANCE = 1e-6
#: Rows up to which a logistic fit is left to Spark, which caches them as they are.
SPARK_ROWS = 1_000_000


def standardize(df: DataFrame, cols: Sequence[str], prefix: str = "z_") -> DataFrame:
    """(x − mean) / population deviation per column; a constant column is only centred."""
    stats = {f"__m_{c}": F.avg(F.col(c).cast("double")) for c in cols}
    stats |= {f"__s_{c}": F.stddev_pop(F.col(c).cast("double")) for c in cols}
    wide = with_group_total(df, None, stats)
    scaled = {
        f"{prefix}{c}": (F.col(c) - F.col(f"__m_{c}"))
        / F.when(F.col(f"__s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}"))
        for c in cols
    }
    return wide.withColumns(scaled).drop(*stats)


def scaling_step(df: DataFrame, cols: Sequence[str], prefix: str = "z_") -> SQLTransformer:
    """The same scaling as a model stage, with the training means and deviations written into it."""
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols],
    ).first()
    return _scaler(cols, [row[f"m_{c}"] for c in cols], [row[f"s_{c}"] for c in cols], prefix)


def _scaler(cols: Sequence[str], means: Sequence[float], deviations: Sequence[float], prefix: str = "z_") -> SQLTransformer:
    parts = [f"((`{c}` - ({m!r}D)) / ({(s or 1.0)!r}D)) AS `{prefix}{c}`" for c, m, s in zip(cols, means, deviations, strict=True)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def impute_median(df: DataFrame, cols: Sequence[str], **limits: int) -> DataFrame:
    """Missing values replaced by the column's exact median."""
    medians = quantile_columns(df, {f"__md_{c}": (c, 0.5) for c in cols}, **limits)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__md_{c}")) for c in cols}
    return df.crossJoin(F.broadcast(medians)).withColumns(filled).drop(*[f"__md_{c}" for c in cols])


def _scaled(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, Column]:
    """The table with standardized columns, and these as an array."""
    return standardize(df, cols), F.array(*[F.col(f"z_{c}") for c in cols])


def _labelled(df: DataFrame, cols: Sequence[str], fit: Centres, name: str) -> DataFrame:
    scaled, vector = _scaled(df, cols)
    return scaled.withColumn(name, fit.label(vector)).drop(*[f"z_{c}" for c in cols])


def fit_kmeans(
    df: DataFrame, cols: Sequence[str], k: int, seeds: Sequence[int] = tuple(range(20))
) -> tuple[Centres, DataFrame]:
    """K-means on standardized columns, best of several starts; returns the model and the labelled rows."""
    (model,), _ = clustering.best_of(*_scaled(df, cols), [Start(k, s) for s in seeds])
    return model, _labelled(df, cols, model, "cluster_id")


def kmeans_sweep(
    df: DataFrame, spaces: Mapping[str, Sequence[str]], ks: Sequence[int] = tuple(range(2, 9)), seeds: Sequence[int] = tuple(range(20))
) -> DataFrame:
    """Per feature space and k: inertia, silhouette, smallest and largest cluster in percent. All spaces, k and starts are fitted together."""
    cols = list(dict.fromkeys(c for own in spaces.values() for c in own))
    dims = {name: tuple(cols.index(c) for c in own) for name, own in spaces.items()}
    starts = [Start(k, s, dims[name]) for name in spaces for k in ks for s in seeds]
    fits, scores = clustering.best_of(*_scaled(df, cols), starts)
    rows = []
    for (name, k), fit, silhouette in zip([(n, k) for n in spaces for k in ks], fits, scores, strict=True):
        sizes = fit.sizes
        rows.append((name, k, fit.inertia, silhouette, float(100.0 * sizes.min() / sizes.sum()), float(100.0 * sizes.max() / sizes.sum())))
    return df.sparkSession.createDataFrame(
        rows,
        "feature_space string, k int, inertia double, silhouette double, smallest_cluster_pct double, largest_cluster_pct double",
    )


def cluster_stability(
    df: DataFrame, cols: Sequence[str], id: str, k: int = 4, seeds: Sequence[int] = (7, 21, 42, 100, 2026), starts: int = 20
) -> DataFrame:
    """Adjusted Rand index of every pair of runs with different seeds. All runs are fitted together, and all labels sit on one table."""
    scaled, vector = _scaled(df, cols)
    points = clustering.with_points(scaled, vector)
    fits = clustering.fit_starts(points, [Start(k, seed + i) for seed in seeds for i in range(starts)])
    discard(points)
    best = [min(fits[n * starts : (n + 1) * starts], key=lambda f: f.inertia) for n in range(len(seeds))]
    labelled = scaled.select(id, *[fit.label(vector).alias(f"run_{seed}") for seed, fit in zip(seeds, best, strict=True)])
    labelled = cut_lineage(labelled)
    pairs = [
        metrics.adjusted_rand(labelled, f"run_{a}", f"run_{b}").select(
            F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), "adjusted_rand"
        )
        for a, b in combinations(seeds, 2)
    ]
    return reduce(DataFrame.unionByName, pairs)


def balanced_weight(df: DataFrame, target: str, name: str = "class_weight") -> DataFrame:
    """n / (2 · rows of the class), repeated on every row."""
    counted = with_group_total(df, None, {"__n": F.count(F.lit(1)), "__p": F.count_if(F.col(target) == 1)})
    of_class = F.when(F.col(target) == 1, F.col("__p")).otherwise(F.col("__n") - F.col("__p"))
    return counted.withColumn(name, F.col("__n") / (2.0 * of_class)).drop("__n", "__p")


def fit_logistic(
    df: DataFrame, cols: Sequence[str], target: str, balanced: bool = False, max_iter: int = 2000, **limits: int
) -> PipelineModel:
    """L2 logistic regression on standardized columns; `balanced` weighs both classes equally."""
    return fit_logistics(df, [(cols, balanced)], target, max_iter, **limits)[0]


def fit_logistics(
    df: DataFrame, fits: Sequence[tuple[Sequence[str], bool]], target: str, max_iter: int = 2000, spark_rows: int = SPARK_ROWS
) -> list[PipelineModel]:
    """One model per (columns, balanced or not).

    Up to `spark_rows` rows are fitted by Spark. More are packed once, and all fits advance in the same passes over them, by the same steps; rows that Spark
    treats in its own way (other labels than 0 and 1, a single class, missing values) are left to it.
    """
    if df.count() <= spark_rows:
        return [_fit_by_spark(df, cols, target, balanced, max_iter) for cols, balanced in fits]
    every = list(dict.fromkeys(c for cols, _ in fits for c in cols))
    blocks = logistic.Blocks(df, every, target)
    try:
        if blocks.moments[2, 0] or not blocks.moments[:2, 0].all():
            return [_fit_by_spark(df, cols, target, balanced, max_iter) for cols, balanced in fits]
        found = logistic.fit_all(blocks, [([every.index(c) for c in cols], balanced) for cols, balanced in fits], max_iter, TOLERANCE)
    finally:
        blocks.close()
    return [_logistic_model(df.sparkSession, cols, target, fit) for (cols, _), fit in zip(fits, found, strict=True)]


def _logistic_model(spark: SparkSession, cols: Sequence[str], target: str, fit: logistic.Fitted) -> PipelineModel:
    """The fit as Spark's own model, with scaling and assembly before it."""
    scaler = _scaler(cols, fit.means.tolist(), fit.deviations.tolist())
    assembler = VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="features")
    estimator = LogisticRegression(featuresCol="features", labelCol=target)
    weights = _py2java(spark.sparkContext, Vectors.dense(fit.coefficients.tolist()))
    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(estimator.uid, weights, fit.intercept)
    return PipelineModel([scaler, assembler, estimator._copyValues(LogisticRegressionModel(java))])


def _fit_by_spark(df: DataFrame, cols: Sequence[str], target: str, balanced: bool, max_iter: int) -> PipelineModel:
    n = df.count()
    data = balanced_weight(df, target) if balanced else df
    scaler = scaling_step(df, cols)
    assembler = VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="features")
    model = LogisticRegression(
        featuresCol="features", labelCol=target, regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=TOLERANCE,
    )
    if balanced:
        model = model.setWeightCol("class_weight")
    fitted = model.fit(assembler.transform(scaler.transform(data)))
    return PipelineModel([scaler, assembler, fitted])


def fit_tree_classifier(
    df: DataFrame, cols: Sequence[str], target: str, rounds: int = 300, depth: int = 4, rate: float = 0.05, seed: int = 42
) -> BoostedTrees:
    """Boosted trees; positives carry the weight negatives / positives."""
    row = df.agg(F.count(F.col(target)).alias("n"), F.count_if(F.col(target) == 1).alias("p")).first()
    weight = F.when(F.col(target) == 1, F.lit((row["n"] - row["p"]) / max(row["p"], 1))).otherwise(F.lit(1.0))
    return boosting.fit(df, target, Options(tuple(cols), rounds, depth, rate=rate, seed=seed), logistic=True, weight=weight)


def positive_probability() -> Column:
    return vector_to_array("probability")[1]


def scored(model: PipelineModel | BoostedTrees, df: DataFrame, name: str = SCORE) -> DataFrame:
    """The input columns and the probability of the positive class."""
    return model.transform(df).select(*df.columns, positive_probability().alias(name))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_population(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Score a population at (customer, snapshot) grain, checked and in decision order."""
    missing = [f for f in [KEY, SNAPSHOT, *features] if f not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if not df.filter(F.col(KEY).isNull()).limit(1).isEmpty():
        raise ValueError(f"{KEY} contains missing values")
    if has_repeats_among(df, KEY, SNAPSHOT):
        raise ValueError("a customer occurs twice at one snapshot")
    table = scored(model, df)
    if not table.filter(~F.col(SCORE).between(0, 1)).limit(1).isEmpty():
        raise ValueError("probabilities outside [0, 1]")
    context = [c for c in ("repeat_purchase_90d", "last_purchase_timestamp") if c in df.columns]
    return sort(table.select(KEY, SNAPSHOT, SCORE, *context), [(SNAPSHOT, "asc"), (SCORE, "desc"), (KEY, "asc")])


def benchmark_models(
    models: Mapping[str, PipelineModel | BoostedTrees], splits: Mapping[str, DataFrame], target: str, id: str,
    capacities: Sequence[float] = (0.01, 0.02, 0.05, 0.10, 0.20), bins: int = 10,
) -> DataFrame:
    """One row per model and split: AUC, average precision, Brier, calibration gap, and precision, recall, lift per capacity.

    Splits of one model are evaluated together, grouped by split.
    """
    tables = []
    for name, model in models.items():
        parts = [scored(model, df).select(F.lit(split).alias("split"), id, target, SCORE) for split, df in splits.items()]
        # every metric reads the scores, so they are computed once
        rows = cut_lineage(reduce(DataFrame.unionByName, parts))
        base = rows.groupBy("split").agg(
            F.count(F.lit(1)).alias("rows"), F.avg(F.col(target).cast("double")).alias("positive_rate")
        )
        lift = metrics.lift_table(rows, SCORE, target, id, capacities, "split")
        named = lift.groupBy("split").agg(
            *[
                F.max(F.when(F.col("capacity") == F.lit(c), F.col(m))).alias(f"top_{int(round(c * 100))}_{m}")
                for c in capacities
                for m in ("precision", "recall", "lift")
            ]
        )
        wanted = [
            metrics.roc_auc(rows, SCORE, target, "split"),
            metrics.average_precision(rows, SCORE, target, "split"),
            metrics.brier(rows, SCORE, target, "split"),
            metrics.calibration_gap(metrics.calibration(rows, SCORE, target, bins, "split"), "split"),
            named,
        ]
        tables.append(reduce(lambda a, b: a.join(b, "split"), wanted, base).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, tables)


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per cluster."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("__n"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", pct(F.col("rows"), F.col("__n"))).drop("__n")
