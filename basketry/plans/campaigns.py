"""Campaign readiness: eligible cohorts, window metrics, balance, pre-period trend, before/during change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.joins import match_coverage, window_totals, without_overlap

HOUSEHOLD, CAMPAIGN, START, END = "household_key", "CAMPAIGN", "START_DAY", "END_DAY"
METRICS = ["sales", "baskets", "active_days"]


def eligible_cohort(
    assignments: DataFrame, campaigns: DataFrame, households: DataFrame, campaign: int | Sequence[int] | None = None
) -> DataFrame:
    """Assigned and comparison households of one, several or all campaigns, free of any overlapping other campaign.

    Assignment is not exposure. Every household is compared with every campaign asked for, so the result is that large.
    """
    targets = campaigns.select(CAMPAIGN, START, END)
    if campaign is not None:
        targets = targets.filter(F.col(CAMPAIGN).isin([campaign] if isinstance(campaign, int) else list(campaign)))
    assigned = assignments.select(HOUSEHOLD, CAMPAIGN).distinct().join(targets.select(CAMPAIGN), CAMPAIGN, "left_semi")
    # the list of campaigns is one row
    listed = targets.agg(F.collect_set(CAMPAIGN).alias("__all"))
    everyone = households.select(HOUSEHOLD).distinct().crossJoin(F.broadcast(listed)).select(HOUSEHOLD, F.explode("__all").alias(CAMPAIGN))
    comparison = everyone.join(assigned, [HOUSEHOLD, CAMPAIGN], "left_anti")
    members = assigned.select(HOUSEHOLD, CAMPAIGN, F.lit("assigned").alias("group_name")).unionByName(
        comparison.withColumn("group_name", F.lit("comparison"))
    )
    free = without_overlap(members, assignments, campaigns, HOUSEHOLD, targets, CAMPAIGN, START, END)
    return free.join(targets, CAMPAIGN).select(CAMPAIGN, START, END, "group_name", HOUSEHOLD)


def daily_baskets(tx: DataFrame) -> DataFrame:
    """Sales per household, day and basket: what the window metrics need, at the smallest size."""
    return tx.groupBy(HOUSEHOLD, "DAY", "BASKET_ID").agg(F.sum("SALES_VALUE").alias("value"))


def household_metrics(cohort: DataFrame, tx: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Sales, baskets and active days per cohort household within [lo, hi]; households without any keep zeros."""
    return window_totals(
        cohort, daily_baskets(tx), HOUSEHOLD, "DAY", lo, hi,
        {
            "sales": F.coalesce(F.sum("value"), F.lit(0.0)),
            "baskets": F.countDistinct("BASKET_ID"),
            "active_days": F.countDistinct("DAY"),
        },
    )


def pre_period_metrics(cohort: DataFrame, tx: DataFrame, days: int = 28) -> DataFrame:
    """Metrics of the `days` before each campaign's start."""
    return household_metrics(cohort, tx, F.col(START) - days, F.col(START) - 1)


def smd(metrics: DataFrame, cols: Sequence[str] = METRICS) -> DataFrame:
    """Standardized mean difference per campaign, groups weighted alike; null below two households or without variance."""

    def of(group: str, col: str) -> Column:
        return F.when(F.col("group_name") == group, F.col(col).cast("double"))

    aggs = []
    for g in ("assigned", "comparison"):
        aggs.append(F.count_if(F.col("group_name") == g).alias(f"{g}_n"))
        for c in cols:
            aggs += [F.avg(of(g, c)).alias(f"{g}_{c}_mean"), F.var_samp(of(g, c)).alias(f"{g}_{c}_var")]
    row = metrics.groupBy(CAMPAIGN).agg(*aggs)

    def value(c: str) -> Column:
        spread = (F.col(f"assigned_{c}_var") + F.col(f"comparison_{c}_var")) / 2
        enough = (F.col("assigned_n") >= 2) & (F.col("comparison_n") >= 2) & (spread > 0)
        return F.when(enough, F.abs(F.col(f"assigned_{c}_mean") - F.col(f"comparison_{c}_mean")) / F.sqrt(spread))

    return row.select(CAMPAIGN, "assigned_n", "comparison_n", *[value(c).alias(f"{c}_smd") for c in cols])


def weekly_trend(cohort: DataFrame, tx: DataFrame, start: int | None = None, weeks: int = 8) -> DataFrame:
    """Mean sales per household, campaign, group and week over the last complete weeks before the start day.

    Without `start` each campaign of the cohort takes its own. The sales are read and summed once, whatever the number of campaigns.
    Households without sales count with zero, so a week's mean is its sales over the group size.
    """
    begins = F.col(START) if start is None else F.lit(start)
    spans = tx.groupBy("WEEK_NO").agg(F.min("DAY").alias("first"), F.max("DAY").alias("last"), F.countDistinct("DAY").alias("days"))
    whole = spans.filter((F.col("first") < F.col("last")) & (F.col("days") == 7))
    # the complete weeks of the calendar are one row; a campaign takes the latest that end before it starts
    calendar = whole.agg(F.sort_array(F.collect_list(F.struct("WEEK_NO", "last")), asc=False).alias("__weeks"))
    starts = cohort.select(CAMPAIGN, begins.alias("__start")).distinct().crossJoin(F.broadcast(calendar))
    latest = F.slice(F.filter("__weeks", lambda w: w["last"] < F.col("__start")), 1, weeks)
    wanted = starts.select(CAMPAIGN, F.explode(latest).alias("__w")).select(CAMPAIGN, F.col("__w.WEEK_NO").alias("WEEK_NO"))
    sales = tx.groupBy(HOUSEHOLD, "WEEK_NO").agg(F.sum("SALES_VALUE").alias("sales")).join(wanted.select("WEEK_NO").distinct(), "WEEK_NO", "left_semi")
    members = cohort.select(CAMPAIGN, "group_name", HOUSEHOLD)
    sizes = members.groupBy(CAMPAIGN, "group_name").agg(F.count(F.lit(1)).alias("n"))
    sums = members.join(sales, HOUSEHOLD).join(wanted, [CAMPAIGN, "WEEK_NO"], "left_semi")
    sums = sums.groupBy(CAMPAIGN, "group_name", "WEEK_NO").agg(F.sum("sales").alias("sales"))
    return sizes.join(wanted, CAMPAIGN).join(sums, [CAMPAIGN, "group_name", "WEEK_NO"], "left").select(
        CAMPAIGN, "group_name", "WEEK_NO", (F.coalesce("sales", F.lit(0.0)) / F.col("n")).alias("mean_sales")
    )


def before_during(cohort: DataFrame, tx: DataFrame) -> DataFrame:
    """Mean metrics in the equally long period before the campaign and during it, and the change."""
    length = F.col(END) - F.col(START) + 1
    parts = []
    for name, lo, hi in (
        ("before", F.col(START) - length, F.col(START) - 1),
        ("during", F.col(START), F.col(END)),
    ):
        per_group = household_metrics(cohort, tx, lo, hi).groupBy(CAMPAIGN, "group_name").agg(
            F.count(F.lit(1)).alias("households"), *[F.avg(m).alias(f"{m}_{name}") for m in METRICS]
        )
        parts.append(per_group if name == "before" else per_group.drop("households"))
    both = parts[0].join(parts[1], [CAMPAIGN, "group_name"])
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(f"{m}_before").alias("before"), F.col(f"{m}_during").alias("during"),
                (F.col(f"{m}_during") - F.col(f"{m}_before")).alias("change"),
            )
            for m in METRICS
        ]
    )
    return both.select(CAMPAIGN, "group_name", "households", F.inline(cells))


def demographic_coverage(cohort: DataFrame, demo: DataFrame) -> DataFrame:
    """Eligible households per group and how many have demographics."""
    return match_coverage(cohort, demo, HOUSEHOLD, [CAMPAIGN, "group_name"])
