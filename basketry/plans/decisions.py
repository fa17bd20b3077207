"""Capacity-limited and threshold decisions over scored populations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.values import count_when, ladder, ratio, target_count
from basketry.operators.joins import has_repeats
from basketry.operators.ordering import as_list, with_group_total
from basketry.operators.windows import rank_by_score
from basketry.plans.models import SCORE, scored

# Evaluated capacities, and the threshold policy with its reasons.
CAPACITIES = [0.01, 0.05, 0.10, 0.20]
REASONS = {
    "prioritize": "Propensity exceeds the current decision-policy threshold.",
    "standard": (
        "Customer has measurable predicted repeat-purchase propensity but does not exceed the current priority threshold."
    ),
    "deprioritize": "Predicted repeat-purchase propensity is below the current decision-policy threshold.",
}


def _validated(df: DataFrame, id: str, score: str, capacities: Sequence[float]) -> None:
    """Reject bad capacities, missing columns, an empty population, missing ids and scores outside [0, 1]."""
    if not all(0 < c <= 1 for c in capacities):
        raise ValueError("capacity must be greater than 0 and at most 1")
    missing = [c for c in (id, score) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    p = F.col(score)
    rows, no_id, bad = df.agg(
        F.count(F.lit(1)), F.count_if(F.col(id).isNull()), F.count_if(p.isNull() | F.isnan(p.cast("double")) | ~p.between(0, 1))
    ).first()
    if rows == 0:
        raise ValueError("cannot prioritize an empty population")
    if no_id:
        raise ValueError(f"{id} contains missing values")
    if bad:
        raise ValueError(f"{score} must be between 0 and 1")


def _ranked(df: DataFrame, id: str, score: str, by: Sequence[str], **limits: int) -> DataFrame:
    ranked = rank_by_score(df, score, id, by, "decision_rank", **limits)
    return with_group_total(ranked, by, {"__n": F.count(F.lit(1))})


def prioritize(
    df: DataFrame, capacity: float, id: str = "customer_id", score: str = SCORE, by: str | Sequence[str] = (), **limits: int
) -> DataFrame:
    """Rank by score (ties by id) and mark the top fraction as `prioritize`, the rest as `standard`.

    With `by` (for example the snapshot) each population is ranked on its own.
    """
    by = as_list(by)
    _validated(df, id, score, [capacity])
    size = target_count(F.col("__n"), capacity)
    return _ranked(df, id, score, by, **limits).withColumns(
        {
            "priority": F.when(F.col("decision_rank") <= size, "prioritize").otherwise("standard"),
            "capacity_fraction": F.lit(float(capacity)),
            "target_population_size": size,
        }
    ).drop("__n")


def threshold_policy(df: DataFrame, score: str = SCORE) -> DataFrame:
    """prioritize from .10, standard from .01, else deprioritize, with the reason."""
    if not df.filter(F.col(score).isNull() | ~F.col(score).between(0, 1)).limit(1).isEmpty():
        raise ValueError(f"{score} must be between 0 and 1")
    p = F.col(score)
    steps = [(p >= 0.10, "prioritize"), (p >= 0.01, "standard")]
    return df.withColumns(
        {
            "decision": ladder(steps, "deprioritize"),
            "reason": ladder([(c, REASONS[d]) for c, d in steps], REASONS["deprioritize"]),
        }
    )


def capacity_decisions(
    df: DataFrame, capacities: Sequence[float] = CAPACITIES, id: str = "customer_unique_id", score: str = SCORE,
    by: str | Sequence[str] = "snapshot_timestamp", label: str = "repeat_purchase_90d", validate: bool = True, **limits: int,
) -> DataFrame:
    """One decision per row and capacity; the population is ranked once for all of them."""
    by = as_list(by)
    if validate:
        _validated(df, id, score, capacities)
        if has_repeats(df, [id, *by]):
            raise ValueError(f"{id} repeats within a population")
    shares = F.array(*[F.lit(float(c)) for c in capacities])
    spread = _ranked(df, id, score, by, **limits).withColumn("capacity_fraction", F.explode(shares))
    size = target_count(F.col("__n"), F.col("capacity_fraction"))
    return spread.select(
        id, *by, score, "decision_rank",
        F.when(F.col("decision_rank") <= size, "prioritize").otherwise("standard").alias("priority"),
        "capacity_fraction", size.alias("target_population_size"), label,
    )


def evaluate_capacity(
    df: DataFrame, capacities: Sequence[float] = CAPACITIES, id: str = "customer_unique_id", score: str = SCORE,
    by: str | Sequence[str] = "snapshot_timestamp", label: str = "repeat_purchase_90d", **limits: int,
) -> DataFrame:
    """Per population and capacity: targeted, captured, base rate, precision, recall, lift."""
    by = as_list(by)
    rows = capacity_decisions(df, capacities, id, score, by, label, **limits)
    chosen, positive = F.col("priority") == "prioritize", F.col(label) == 1
    table = rows.groupBy(*by, "capacity_fraction").agg(
        F.count(F.lit(1)).alias("population_size"),
        count_when(chosen).alias("targeted_count"),
        count_when(positive).alias("total_positive"),
        count_when(chosen & positive).alias("captured_positive"),
    )
    base = ratio(F.col("total_positive"), F.col("population_size"), on_zero=0.0)
    precision = ratio(F.col("captured_positive"), F.col("targeted_count"), on_zero=0.0)
    return table.withColumns(
        {
            "baseline_positive_rate": base,
            "precision": precision,
            "recall": ratio(F.col("captured_positive"), F.col("total_positive"), on_zero=0.0),
            "lift": ratio(precision, base, on_zero=0.0),
        }
    )


def capacity_summary(evaluation: DataFrame) -> DataFrame:
    """Means over the populations, per capacity."""
    return evaluation.groupBy("capacity_fraction").agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.avg("population_size").alias("mean_population_size"),
        F.avg("targeted_count").alias("mean_targeted_count"),
        F.sum("captured_positive").alias("total_captured_positive"),
        F.avg("baseline_positive_rate").alias("mean_baseline_positive_rate"),
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        F.avg("lift").alias("mean_lift"),
    )


def decide_batch(model: PipelineModel, requests: DataFrame, capacity: float, id: str = "customer_id") -> DataFrame:
    """Score a request table and prioritize it; repeated ids are rejected."""
    if has_repeats(requests, id):
        raise ValueError(f"{id} values must be unique within a decision population")
    table = scored(model, requests).select(id, SCORE)
    sized = with_group_total(prioritize(table, capacity, id), None, {"population_size": F.count(F.lit(1))})
    return sized.orderBy("decision_rank")
