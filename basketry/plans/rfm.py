"""Recency, frequency, monetary value: table, bands, segments, cluster profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.dates import whole_days
from basketry.functions.values import band, count_when, ladder, pct
from basketry.operators.aggregates import (
    correlation_matrix, crosstab, describe_long, frequency_table, unpivot_row, with_global,
)
from basketry.operators.columns import with_literals
from basketry.operators.ordering import join_groups, quantile_columns, quantiles

KEY = "customer_unique_id"
PROFILE_POINTS = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]

INF = float("inf")
# Band edges (right-closed) and labels.
BANDS = {
    "frequency_class": ("frequency", [0, 1, 2, 3, INF], ["1 order", "2 orders", "3 orders", "4+ orders"], True),
    "recency_band": (
        "recency_days", [-1, 90, 180, 365, 545, INF],
        ["0-90 days", "91-180 days", "181-365 days", "366-545 days", "546+ days"], False,
    ),
    "monetary_band": (
        "monetary", [-0.01, 50, 100, 250, 500, 1000, INF],
        ["<= R$50", "R$50-R$100", "R$100-R$250", "R$250-R$500", "R$500-R$1,000", "> R$1,000"], True,
    ),
}


def rfm(customer_360: DataFrame, validate: bool = False) -> DataFrame:
    """Recency in whole days before the latest order of all, frequency, monetary value."""
    base = customer_360.select(
        KEY, "first_order_date", "last_order_date", "total_orders", "total_payment_value", "average_order_value",
        "is_repeat_customer", "payment_observation_status",
    )
    cut = with_global(base, "analysis_cutoff_timestamp", F.max("last_order_date"))
    table = cut.withColumns(
        {
            "recency_days": whole_days(F.col("analysis_cutoff_timestamp"), F.col("last_order_date")),
            "frequency": F.col("total_orders"),
            "monetary": F.col("total_payment_value"),
        }
    )
    if validate:
        bad = table.filter((F.col("recency_days") < 0) | (F.col("frequency") < 1))
        if not bad.limit(1).isEmpty():
            raise ValueError("negative recency or frequency below one")
    return table


def rfm_summary(table: DataFrame, **limits: int) -> DataFrame:
    """Recency and monetary distributions."""
    return describe_long(table, ["recency_days", "monetary"], PROFILE_POINTS, **limits)


def frequency_distribution(table: DataFrame) -> DataFrame:
    return frequency_table(table, "frequency", "customers")


def repeat_profile(table: DataFrame, **limits: int) -> DataFrame:
    """One-time against repeat customers."""
    by = "is_repeat_customer"
    base = table.groupBy(by).agg(
        F.count(KEY).alias("customers"),
        F.median("recency_days").alias("median_recency"),
        F.median("frequency").alias("median_frequency"),
        F.avg("monetary").alias("mean_monetary"),
    )
    joined = join_groups(base, quantile_columns(table, {"median_monetary": ("monetary", 0.5)}, by, **limits), [by])
    total = joined.agg(F.sum("customers").alias("__n"))
    return joined.crossJoin(F.broadcast(total)).withColumn("percentage", pct(F.col("customers"), F.col("__n"))).drop("__n")


def monetary_concentration(table: DataFrame, ps: tuple[float, ...] = (0.90, 0.95, 0.99), **limits: int) -> DataFrame:
    """Customers at or above each monetary percentile and their part of all value."""
    known = table.filter(F.col("monetary").isNotNull()).select("monetary")
    cuts = quantiles(known, "monetary", ps, **limits).select("p", F.col("value").alias("threshold"))
    listed = cuts.agg(F.collect_list(F.struct("p", "threshold")).alias("cuts"))
    spread = known.crossJoin(F.broadcast(listed))
    total = known.agg(F.sum("monetary").alias("__total"))
    above = (
        spread.select("monetary", F.explode("cuts").alias("c"))
        .filter(F.col("monetary") >= F.col("c.threshold"))
        .groupBy(F.col("c.p").alias("p"), F.col("c.threshold").alias("threshold"))
        .agg(F.count(F.lit(1)).alias("customers_above"), F.sum("monetary").alias("value_above"))
    )
    return above.crossJoin(F.broadcast(total)).select(
        "p", "threshold", "customers_above", pct(F.col("value_above"), F.col("__total")).alias("value_share_pct")
    )


def rfm_ties(table: DataFrame) -> DataFrame:
    """Distinct values per measure."""
    names = ["recency_days", "frequency", "monetary"]
    row = table.agg(*[F.countDistinct(c).alias(c) for c in names])
    return unpivot_row(row, "column", {c: {"unique_values": F.col(c)} for c in names})


def rfm_correlation(table: DataFrame) -> DataFrame:
    return correlation_matrix(table, ["recency_days", "frequency", "monetary"])


def with_band(table: DataFrame, name: str) -> DataFrame:
    """Add one of the declared bands as a column."""
    col, edges, labels, lowest = BANDS[name]
    return table.withColumn(name, band(F.col(col), edges, labels, lowest))


def _value_profile(table: DataFrame, by: str, **limits: int) -> DataFrame:
    """Customers, value and medians per group; medians of small-domain columns are plain aggregates."""
    base = table.groupBy(by).agg(
        F.count(KEY).alias("customers"),
        F.coalesce(F.sum("monetary"), F.lit(0.0)).alias("total_monetary"),
        F.avg("monetary").alias("mean_monetary"),
        F.median("recency_days").alias("median_recency"),
        F.median("frequency").alias("median_frequency"),
    )
    medians = quantile_columns(table, {"median_monetary": ("monetary", 0.5)}, by, **limits)
    return join_groups(base, medians, [by], "left")


def _with_shares(profile: DataFrame, table: DataFrame) -> DataFrame:
    totals = table.agg(F.count(F.lit(1)).alias("__n"), F.sum("monetary").alias("__value"))
    return profile.crossJoin(F.broadcast(totals)).withColumns(
        {
            "customer_pct": pct(F.col("customers"), F.col("__n")),
            "value_pct": pct(F.col("total_monetary"), F.col("__value")),
        }
    ).drop("__n", "__value")


def band_summary(table: DataFrame, name: str, **limits: int) -> DataFrame:
    """One row per band, empty bands included."""
    banded = with_band(table, name)
    labels = table.sparkSession.createDataFrame([(label,) for label in BANDS[name][2]], f"{name} string")
    profile = _value_profile(banded.filter(F.col(name).isNotNull()), name, **limits)
    whole = labels.join(profile, name, "left").na.fill(0, ["customers"]).na.fill(0.0, ["total_monetary"])
    return _with_shares(whole, table)


def band_crosstab(table: DataFrame, name: str) -> DataFrame:
    """Band by one-time/repeat, with totals."""
    return crosstab(with_band(table, name), name, "is_repeat_customer", [False, True], names=["one_time", "repeat"])


def rule_segments(table: DataFrame) -> DataFrame:
    """Interpretable segment per customer."""
    once, recent, old = F.col("frequency") == 1, F.col("recency_days") <= 180, F.col("recency_days") > 365
    high = F.col("monetary") >= 250
    segment = ladder(
        [
            (F.col("monetary").isNull(), "Payment data unavailable"),
            (once & recent & high, "Recent high-value one-time"),
            (once & recent, "Recent one-time"),
            (once & old & high, "Older high-value one-time"),
            (once, "Older one-time"),
            (recent & (F.col("frequency") >= 3), "Recent frequent repeat"),
            (recent, "Recent repeat"),
            (old, "Lapsed repeat"),
        ],
        "Established repeat",
    )
    return table.withColumn("baseline_segment", segment)


def segment_summary(segmented: DataFrame, **limits: int) -> DataFrame:
    """Size, medians and value part per segment."""
    return _with_shares(_value_profile(segmented, "baseline_segment", **limits), segmented)


def clustering_input(table: DataFrame, validate: bool = False) -> DataFrame:
    """Customers with observed payments, with log monetary value."""
    known = table.filter(F.col("payment_observation_status") == "observed").withColumn("log_monetary", F.log1p("monetary"))
    chosen = known.select(KEY, "recency_days", "frequency", "monetary", "log_monetary", "is_repeat_customer")
    if validate:
        bad = reduce(
            lambda a, b: a | b,
            [F.col("recency_days") < 0, F.col("frequency") < 1, F.col("monetary") < 0, F.col("log_monetary").isNull()],
        )
        if not chosen.filter(bad).limit(1).isEmpty():
            raise ValueError("clustering input out of range")
    return chosen


def cluster_profile(df: DataFrame, label: str, **limits: int) -> DataFrame:
    """Size, R-F-M medians and means, value and repeat parts per cluster."""
    base = df.groupBy(label).agg(
        F.count(KEY).alias("customers"),
        F.median("recency_days").alias("median_recency"),
        F.avg("recency_days").alias("mean_recency"),
        F.median("frequency").alias("median_frequency"),
        F.avg("frequency").alias("mean_frequency"),
        F.avg("monetary").alias("mean_monetary"),
        F.sum("monetary").alias("total_monetary"),
        count_when(F.col("is_repeat_customer")).alias("repeat_customers"),
    )
    medians = quantile_columns(df, {"median_monetary": ("monetary", 0.5)}, label, **limits)
    profile = _with_shares(join_groups(base, medians, [label], "left"), df)
    return profile.withColumn("repeat_rate_pct", pct(F.col("repeat_customers"), F.col("customers")))


def name_clusters(profile: DataFrame, label: str = "cluster_id") -> DataFrame:
    """A segment name per cluster, read off its measured profile.

    Highest median frequency is the repeat cluster, highest median value of the
    others the high-value one; of the rest the lowest median recency is recent,
    the highest older. The profile has one row per cluster, so its windows are tiny.
    """
    everyone = Window.partitionBy()
    ranked = profile.withColumn(
        "__rep", F.row_number().over(everyone.orderBy(F.desc("median_frequency"), F.asc(label)))
    )
    ranked = ranked.withColumn(
        "__val",
        F.row_number().over(everyone.orderBy((F.col("__rep") == 1).asc(), F.desc("median_monetary"), F.asc(label))),
    )
    taken = (F.col("__rep") == 1) | (F.col("__val") == 1)
    ranked = ranked.withColumn(
        "__rec", F.row_number().over(everyone.orderBy(taken.asc(), F.asc("median_recency"), F.asc(label)))
    ).withColumn("__old", F.row_number().over(everyone.orderBy(taken.asc(), F.desc("median_recency"), F.asc(label))))
    name = ladder(
        [
            (F.col("__rep") == 1, "Repeat Customers"),
            (F.col("__val") == 1, "High-Value One-Time"),
            (F.col("__old") == 1, "Older One-Time"),
            (F.col("__rec") == 1, "Recent One-Time"),
        ]
    )
    return ranked.select(label, name.alias("segment_name"))


def customer_segments(clustered: DataFrame, label: str = "cluster_id", n_clusters: int = 4, seed: int = 42) -> DataFrame:
    """Named segments with the metadata of the model they come from."""
    names = name_clusters(cluster_profile(clustered, label), label)
    named = clustered.join(names, label)
    return with_literals(
        named.select(KEY, "recency_days", "frequency", "monetary", label, "segment_name"),
        {
            "segmentation_model": "KMeans",
            "segmentation_version": "v1.0",
            "segmentation_features": "recency_days,frequency,monetary",
            "scaling_method": "StandardScaler",
            "n_clusters": n_clusters,
            "random_state": seed,
        },
    )
