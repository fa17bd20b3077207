"""Evaluation of scores: ranking, calibration, lift, classification. Exact, per group, at any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.values import count_when, ratio, target_count
from basketry.operators.aggregates import describe_long
from basketry.operators.ordering import as_list, join_groups, quantiles, running_totals, with_group_total
from basketry.operators.windows import rank_by_score, rank_first

CAPACITIES = [0.01, 0.02, 0.05, 0.10, 0.20, 0.30, 0.50]


def _by_score(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score: what ranking metrics need of the rows."""
    return df.groupBy(*by, F.col(score).alias("__score")).agg(
        count_when(F.col(label) == 1).alias("__pos"), count_when(F.col(label) != 1).alias("__neg")
    )


def _grouped(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def roc_auc(df: DataFrame, score: str, label: str, by: str | Sequence[str] = (), **limits: int) -> DataFrame:
    """Probability that a positive outranks a negative, ties counted half. Null with only one class."""
    by = as_list(by)
    steps = running_totals(_by_score(df, score, label, by), by, "__score", {"__below": F.col("__neg")}, **limits)
    won = F.col("__pos") * (F.col("__below") - F.col("__neg") / 2.0)
    sums = _grouped(steps, by, F.sum(won).alias("won"), F.sum("__pos").alias("p"), F.sum("__neg").alias("n"))
    return sums.select(*by, F.try_divide(F.col("won"), F.col("p").cast("double") * F.col("n")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str, by: str | Sequence[str] = (), **limits: int) -> DataFrame:
    """Precision at each distinct threshold, weighted by the recall it adds."""
    by = as_list(by)
    counted = {"__tp": F.col("__pos"), "__all": F.col("__pos") + F.col("__neg")}
    steps = running_totals(_by_score(df, score, label, by), by, F.col("__score").desc(), counted, **limits)
    weighted = F.col("__pos") * F.col("__tp") / F.col("__all")
    sums = _grouped(steps, by, F.sum(weighted).alias("w"), F.sum("__pos").alias("p"))
    return sums.select(*by, F.try_divide("w", "p").alias("average_precision"))


def brier(df: DataFrame, score: str, label: str, by: str | Sequence[str] = ()) -> DataFrame:
    miss = F.col(score) - F.col(label)
    return _grouped(df, as_list(by), F.avg(miss * miss).alias("brier_score"))


def calibration(
    df: DataFrame, score: str, label: str, bins: int = 10, by: str | Sequence[str] = (), **limits: int
) -> DataFrame:
    """Quantile bins (right-closed, empty ones dropped): mean score, observed rate, absolute gap."""
    by = as_list(by)
    inner = [i / bins for i in range(1, bins)]
    edges = quantiles(df, score, inner, by, **limits)
    edges = _grouped(edges, by, F.array_sort(F.collect_list(F.struct("p", "value"))).alias("__edges"))
    placed = join_groups(df.select(*by, score, label), edges, by)
    index = F.size(F.filter("__edges", lambda e: e["value"] < F.col(score)))
    binned = placed.groupBy(*by, (index + 1).alias("__bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(score).alias("mean_predicted_probability"),
        F.avg(F.col(label).cast("double")).alias("observed_positive_rate"),
    )
    # bins of one curve are at most `bins` rows per group
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*by).orderBy("__bin"))
    return binned.withColumn("bin", number).drop("__bin").withColumn(
        "absolute_gap", F.abs(F.col("mean_predicted_probability") - F.col("observed_positive_rate"))
    )


def calibration_gap(curve: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    return _grouped(curve, as_list(by), F.avg("absolute_gap").alias("mean_absolute_calibration_gap"))


def lift_table(
    df: DataFrame,
    score: str,
    label: str,
    id: str,
    capacities: Sequence[float] = CAPACITIES,
    by: str | Sequence[str] = (),
    **limits: int,
) -> DataFrame:
    """Per capacity: targeted rows, positives caught, precision, recall, lift over the base rate."""
    by = as_list(by)
    ranked = rank_by_score(df.select(*by, id, score, label), score, id, by, "__rank", **limits)
    ranked = with_group_total(ranked, by, {"__n": F.count(F.lit(1))})
    positive = F.col(label) == 1
    # all capacities are counted in one pass over the ranks
    caught = [
        count_when((F.col("__rank") <= target_count(F.col("__n"), float(c))) & positive).alias(f"__c{i}")
        for i, c in enumerate(capacities)
    ]
    sums = _grouped(
        ranked, by, F.count(F.lit(1)).alias("population"), count_when(positive).alias("total_positive"), *caught
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(float(c)).alias("capacity"), target_count(F.col("population"), float(c)).alias("targeted"),
                F.col(f"__c{i}").alias("captured"),
            )
            for i, c in enumerate(capacities)
        ]
    )
    table = sums.select(*by, "population", "total_positive", F.inline(cells))
    precision = F.col("captured") / F.col("targeted").cast("double")
    base = ratio(F.col("total_positive"), F.col("population"), on_zero=0.0)
    return table.withColumns(
        {
            "baseline_positive_rate": base,
            "precision": precision,
            "recall": ratio(F.col("captured"), F.col("total_positive"), on_zero=0.0),
            "lift": ratio(precision, base, on_zero=0.0),
        }
    )


def stability_by_month(df: DataFrame, score: str, label: str, time: str, bins: int = 5, **limits: int) -> DataFrame:
    """All metrics per month; a month with only one class is left out."""
    monthly = df.select(F.date_format(time, "yyyy-MM").alias("month"), score, label)
    base = monthly.groupBy("month").agg(
        F.count(F.lit(1)).alias("rows"),
        count_when(F.col(label) == 1).alias("positive_count"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )
    base = base.filter((F.col("positive_count") > 0) & (F.col("positive_count") < F.col("rows")))
    parts = [
        roc_auc(monthly, score, label, "month", **limits),
        average_precision(monthly, score, label, "month", **limits),
        brier(monthly, score, label, "month"),
        calibration_gap(calibration(monthly, score, label, bins, "month"), "month"),
    ]
    for part in parts:
        base = base.join(part, "month")
    return base.orderBy("month")


def compare_rankings(
    df: DataFrame, score_a: str, score_b: str, id: str | Sequence[str], capacities: Sequence[float] = (0.01, 0.02, 0.05, 0.10, 0.20), **limits: int
) -> DataFrame:
    """Agreement of two scores: rank correlation, and overlap and Jaccard of the top ids per capacity.

    The first id column is what the top sets are made of; further ones make rows distinct.
    """
    ids = as_list(id)
    ranked = rank_first(df.select(*ids, score_a, score_b), score_a, ids, "rank_a", **limits)
    ranked = rank_first(ranked, score_b, ids, "rank_b", **limits)
    ranked = with_group_total(ranked, None, {"__n": F.count(F.lit(1)), "spearman": F.corr("rank_a", "rank_b")})
    # per id the best rank on each side decides whether it is in a top set
    best = ranked.groupBy(ids[0]).agg(
        F.min("rank_a").alias("a"), F.min("rank_b").alias("b"), F.max("__n").alias("__n"), F.max("spearman").alias("spearman")
    )
    counts = []
    for i, c in enumerate(capacities):
        cut = target_count(F.col("__n"), float(c))
        in_a, in_b = F.col("a") <= cut, F.col("b") <= cut
        counts += [count_when(in_a & in_b).alias(f"__o{i}"), count_when(in_a | in_b).alias(f"__u{i}")]
    sums = best.agg(F.max("__n").alias("__rows"), F.max("spearman").alias("spearman"), *counts)
    cells = F.array(
        *[
            F.struct(
                F.lit(float(c)).alias("capacity"), target_count(F.col("__rows"), float(c)).alias("n"),
                F.col(f"__o{i}").alias("overlap_count"), F.col(f"__u{i}").alias("union_count"),
            )
            for i, c in enumerate(capacities)
        ]
    )
    return sums.select("spearman", F.inline(cells)).withColumns(
        {
            "overlap_rate": F.try_divide("overlap_count", "n"),
            "jaccard_similarity": ratio(F.col("overlap_count"), F.col("union_count"), on_zero=0.0),
        }
    )


def score_distribution(df: DataFrame, scores: Sequence[str], **limits: int) -> DataFrame:
    return describe_long(df, scores, [0.01, 0.05, 0.50, 0.95, 0.99], **limits)


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Rows per (label, prediction)."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(F.count(F.lit(1)).alias("rows"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted rows; undefined values are 0."""
    cells = confusion(df, label, pred)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("rows").alias("support"), F.lit(0).cast("long").alias("guessed"), F.lit(0).cast("long").alias("hit")),
        F.struct(
            F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("rows").alias("guessed"),
            F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0).alias("hit"),
        ),
    )
    classes = cells.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit")
    )
    precision = ratio(F.col("hit"), F.col("guessed"), on_zero=0.0)
    recall = ratio(F.col("hit"), F.col("support"), on_zero=0.0)
    f1 = ratio(2 * F.col("hit"), F.col("guessed") + F.col("support"), on_zero=0.0)
    per_class = classes.select(
        F.col("class").cast("string").alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        "support", "hit",
    )
    total = F.sum("support")
    row = per_class.agg(
        total.alias("n"), F.sum("hit").alias("hits"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )
    accuracy = F.try_divide("hits", "n")
    averages = row.select(
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("class"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), F.col("n").alias("support")),
                *[
                    F.struct(
                        F.lit(f"{kind} avg").alias("class"),
                        *[F.col(f"{kind}_{c}").alias(c) for c in ("precision", "recall", "f1")],
                        F.col("n").alias("support"),
                    )
                    for kind in ("macro", "weighted")
                ],
            )
        )
    )
    return per_class.drop("hit").unionByName(averages)


def adjusted_rand(df: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """Chance-corrected agreement of two labelings, from their contingency counts."""
    cells = df.groupBy(F.col(label_a).alias("a"), F.col(label_b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))

    def pairs(counts: DataFrame, name: str) -> DataFrame:
        return counts.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))

    both = pairs(cells, "both")
    in_a = pairs(cells.groupBy("a").agg(F.sum("n").alias("n")), "in_a")
    in_b = pairs(cells.groupBy("b").agg(F.sum("n").alias("n")), "in_b")
    every = pairs(cells.agg(F.sum("n").alias("n")), "every")
    row = both.crossJoin(F.broadcast(in_a)).crossJoin(F.broadcast(in_b)).crossJoin(F.broadcast(every))
    expected = F.try_divide(F.col("in_a") * F.col("in_b"), F.col("every"))
    most = (F.col("in_a") + F.col("in_b")) / 2
    score = F.when(most == expected, F.lit(1.0)).otherwise(F.try_divide(F.col("both") - expected, most - expected))
    return row.select(score.alias("adjusted_rand"))
