"""Voice of customer: themes, trends, alerts, root-cause leads, decision records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.dates import fractional_days, month_start
from basketry.functions.values import clip, count_when, joined_set, ladder, map_labels, ratio, record_id
from basketry.operators.aggregates import with_global
from basketry.operators.ordering import join_groups, quantile_columns, with_group_total
from basketry.operators.sets import union_all
from basketry.operators.topk import top_n_per_group
from basketry.operators.windows import add_trailing, period_change
from basketry.plans import clustering
from basketry.plans.clustering import Start

# Analyst names of the themes.
THEME_NAMES = {
    0: "Overall Positive / Trust & Satisfaction",
    1: "Positive Delivery & Fulfillment",
    2: "Generic Positive Satisfaction",
    3: "Delivery & Service Failures",
    4: "Product Quality / Product Mismatch",
}
OTHER_THEME = "Uninterpreted Semantic Cluster"

# Texts of alerts and records.
ACTIONS = {
    "HIGH": "Investigate this customer-experience theme as a high-priority signal.",
    "WARNING": "Monitor this theme and investigate the underlying review evidence.",
    "NORMAL": "No abnormal VoC signal detected relative to the trailing baseline.",
    "INSUFFICIENT_HISTORY": "Insufficient historical evidence for a reliable alert.",
}
RECORD_ACTION = (
    "Investigate the underlying customer-review evidence and determine whether the signal corresponds to a delivery, "
    "service, seller, or fulfillment issue."
)
RECORD_BOUNDARY = (
    "This alert identifies an abnormal customer-review signal. It does not establish operational causality or estimate "
    "financial impact."
)
NEXT_STEPS = [
    "Break the theme down by product category.",
    "Break the theme down by seller.",
    "Compare affected orders by geography.",
    "Inspect delivery-time and order-status signals.",
    "Review representative customer comments.",
]
SUMMARY_ACTIONS = [
    "Review high-concentration product categories.",
    "Investigate sellers with elevated theme concentration.",
    "Investigate geographic concentrations where review volume is sufficient.",
    "Cross-check customer-review signals against operational order and delivery evidence.",
]
SUMMARY_BOUNDARY = (
    "The investigation identifies observational concentrations and associations in customer-review data and operational "
    "fields. It does not establish causality, incremental financial impact, or root cause."
)


def theme_name(cluster: Column) -> Column:
    return map_labels(cluster, THEME_NAMES, OTHER_THEME)


# --- themes ---------------------------------------------------------------------------------------


def discover_themes(
    df: DataFrame, vec: str, ks: Sequence[int] = (5, 8, 10, 12, 15), seed: int = 42, name: str = "semantic_theme_cluster",
    starts: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """K-means per k on the embedding column, best of `starts`; returns (labelled rows of the best silhouette, one row per k)."""
    fits, scores = clustering.best_of(df, F.col(vec), [Start(k, seed + i) for k in ks for i in range(starts)], max_iter=100)
    results = [(k, s, int(f.sizes.min()), int(f.sizes.max())) for k, f, s in zip(ks, fits, scores, strict=True)]
    best = fits[max(range(len(fits)), key=lambda i: scores[i])]
    table = df.sparkSession.createDataFrame(results, "k int, silhouette double, smallest_cluster long, largest_cluster long")
    return df.withColumn(name, best.label(F.col(vec))), table


def theme_profile(reviews: DataFrame, label: str = "semantic_theme_cluster") -> DataFrame:
    """Size, share, mean score and negative/neutral/positive rates per theme."""
    score = F.col("review_score")
    rate = {"negative_rate": score <= 2, "neutral_rate": score == 3, "positive_rate": score >= 4}
    table = reviews.groupBy(F.col(label).alias("cluster")).agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg(score).alias("mean_review_score"),
        *[F.avg(c.cast("double")).alias(n) for n, c in rate.items()],
    )
    total = table.agg(F.sum("review_count").alias("__n"))
    return table.crossJoin(F.broadcast(total)).withColumn("share", ratio(F.col("review_count"), F.col("__n"))).drop("__n")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def representatives(df: DataFrame, vec: str, label: str, id: str, n: int = 15) -> DataFrame:
    """The n rows of each cluster nearest to its centroid by cosine distance.

    Centroids are partial means per task and cluster; the pick keeps n rows per
    cluster in every task before anything is shuffled.
    """
    rows = df.withColumn("__v", F.col(vec).cast("array<double>"))
    centres = rows.groupBy(label).agg(vector_to_array(Summarizer.mean(array_to_vector("__v"))).alias("__c"))
    near = join_groups(rows, centres, [label])
    cosine = F.try_divide(_dot(F.col("__v"), F.col("__c")), F.sqrt(_dot(F.col("__v"), F.col("__v")) * _dot(F.col("__c"), F.col("__c"))))
    # a zero vector has no direction: its distance is 1
    near = near.withColumn("distance_to_centroid", 1.0 - F.coalesce(cosine, F.lit(0.0))).drop("__v", "__c")
    return top_n_per_group(near, label, ["distance_to_centroid", id], n)


# --- trends and alerts ----------------------------------------------------------------------------


def theme_observations(assignments: DataFrame) -> DataFrame:
    """Dated assignments with month and theme name."""
    dated = assignments.filter(F.col("review_creation_date").isNotNull())
    return dated.withColumns(
        {"month": month_start(F.col("review_creation_date")), "theme_name": theme_name(F.col("semantic_theme_cluster"))}
    )


def theme_trends(df: DataFrame, period: str, theme: str | Sequence[str], score: str = "review_score") -> DataFrame:
    """Per period and theme: volume, mean score, dissatisfaction, share of the period, change to the period before.

    The first theme column identifies the series, further ones are attributes of it.
    """
    keys = [theme] if isinstance(theme, str) else list(theme)
    counts = df.groupBy(period, *keys).agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg(score).alias("mean_review_score"),
        count_when(F.col(score) <= 2).alias("dissatisfied_reviews"),
    )
    # period totals come from the small table of counts, not from the rows again
    table = with_group_total(
        counts, period, {"total_reviews": F.sum("review_count"), "total_dissatisfied": F.sum("dissatisfied_reviews")}
    )
    table = table.withColumns(
        {
            "theme_share": ratio(F.col("review_count"), F.col("total_reviews")),
            "theme_dissatisfaction_rate": ratio(F.col("dissatisfied_reviews"), F.col("review_count")),
            "overall_month_dissatisfaction_rate": ratio(F.col("total_dissatisfied"), F.col("total_reviews")),
        }
    )
    table = period_change(table, "theme_share", keys[0], period, "theme_share_mom_change")
    return period_change(table, "theme_dissatisfaction_rate", keys[0], period, "dissatisfaction_rate_mom_change")


def theme_summary(df: DataFrame, theme: Sequence[str], score: str = "review_score") -> DataFrame:
    """Per theme over all periods."""
    table = df.groupBy(*theme).agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg(score).alias("mean_review_score"),
        count_when(F.col(score) <= 2).alias("dissatisfied_reviews"),
    )
    total = table.agg(F.sum("review_count").alias("__n"))
    return table.crossJoin(F.broadcast(total)).withColumns(
        {
            "share": ratio(F.col("review_count"), F.col("__n")),
            "dissatisfaction_rate": ratio(F.col("dissatisfied_reviews"), F.col("review_count")),
        }
    ).drop("__n")


def theme_alerts(
    trends: DataFrame, period: str = "month", theme: str = "semantic_theme_cluster", min_reviews: int = 100,
    trailing: int = 6, min_periods: int = 3,
) -> DataFrame:
    """Each theme period against its trailing baseline: z-score, change, level, priority, action."""
    share, unhappy = "theme_share", "theme_dissatisfaction_rate"
    table = add_trailing(trends, share, [trailing], ["mean", "std"], theme, period, min_periods, "s")
    table = add_trailing(table, unhappy, [trailing], ["mean"], theme, period, min_periods, "d")
    table = table.withColumnsRenamed(
        {f"s_mean_{trailing}": "baseline_share", f"s_std_{trailing}": "baseline_share_std", f"d_mean_{trailing}": "baseline_dissatisfaction"}
    )
    table = table.withColumn("share_deviation", F.col(share) - F.col("baseline_share")).withColumns(
        {
            "share_z_score": F.when(
                F.col("baseline_share_std") > 0, F.col("share_deviation") / F.col("baseline_share_std")
            ),
            "dissatisfaction_change": F.col(unhappy) - F.col("baseline_dissatisfaction"),
            "eligible_for_alert": (F.col("review_count") >= min_reviews)
            & F.col("baseline_share").isNotNull()
            & F.col("baseline_dissatisfaction").isNotNull(),
        }
    )
    z, change = F.coalesce("share_z_score", F.lit(float("-inf"))), F.coalesce("dissatisfaction_change", F.lit(float("-inf")))
    level = ladder(
        [
            (~F.col("eligible_for_alert"), "INSUFFICIENT_HISTORY"),
            (((z >= 3.0) & (change >= 0.10)) | ((z >= 2.0) & (change >= 0.20)), "HIGH"),
            ((z >= 2.0) | (change >= 0.10), "WARNING"),
        ],
        "NORMAL",
    )
    table = with_global(table, "__most", F.max("review_count"))
    part_share = F.coalesce(clip(F.col("share_z_score"), 0.0, 5.0), F.lit(0.0)) / 5.0
    part_change = F.coalesce(clip(F.col("dissatisfaction_change"), 0.0, 0.5), F.lit(0.0)) / 0.5
    part_volume = F.log1p("review_count") / F.log1p("__most")
    table = table.withColumns(
        {
            "alert_level": level,
            "priority_score": clip(0.45 * part_share + 0.40 * part_change + 0.15 * part_volume, 0.0, 1.0),
        }
    ).withColumn("recommended_action", map_labels(F.col("alert_level"), ACTIONS))
    names = dict.fromkeys(
        [
            period, theme, "theme_name", "review_count", share, "baseline_share", "share_deviation", "share_z_score",
            unhappy, "baseline_dissatisfaction", "dissatisfaction_change", "eligible_for_alert", "alert_level",
            "priority_score", "recommended_action",
        ]
    )
    return table.select(*names).orderBy(F.col(period).asc(), F.col("priority_score").desc(), F.col(theme).asc())


# --- investigation --------------------------------------------------------------------------------


def line_context(items: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """Distinct (order, category, seller, seller state)."""
    lines = items.select("order_id", "product_id", "seller_id").distinct()
    return (
        lines.join(products.select("product_id", "product_category_name"), "product_id", "left")
        .join(sellers.select("seller_id", "seller_state"), "seller_id", "left")
        .select("order_id", "product_category_name", "seller_id", "seller_state")
        .distinct()
    )


def review_context(
    reviews: DataFrame, orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame, sellers: DataFrame,
    target: int | None = None,
) -> DataFrame:
    """Reviews with order, customer and order-level item context, and delivery measures.

    Items are combined per order first, so no review row is multiplied.
    """
    context = line_context(items, products, sellers).groupBy("order_id").agg(
        joined_set(F.col("product_category_name")).alias("product_categories"),
        joined_set(F.col("seller_id")).alias("seller_ids"),
        joined_set(F.col("seller_state")).alias("seller_states"),
    )
    place = customers.select(
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"
    )
    buying = orders.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    table = reviews.join(buying, "order_id", "left").join(place, "customer_id", "left").join(context, "order_id", "left")
    arrived = F.col("order_delivered_customer_date")
    delay = fractional_days(arrived, F.col("order_estimated_delivery_date"))
    flags = {
        "delivery_delay_days": delay,
        "purchase_to_delivery_days": fractional_days(arrived, F.col("order_purchase_timestamp")),
        "delivered_late": F.coalesce(delay > 0, F.lit(False)),
        "has_delivery_date": arrived.isNotNull(),
        "is_dissatisfied": F.col("review_score") <= 2,
    }
    if target is not None:
        flags["is_target_theme"] = F.col("semantic_theme_cluster") == target
    return table.withColumns(flags)


def _concentration(rows: DataFrame, dim: str, everyone: bool) -> DataFrame:
    """Counts per value; the two rates are over the target reviews, or over all reviews of the value."""
    hit = F.col("is_target_theme")
    of = F.lit(True) if everyone else hit
    return rows.groupBy(dim).agg(
        F.count(F.lit(1)).alias("review_count"),
        count_when(hit).alias("target_theme_count"),
        F.avg(F.when(of, F.col("is_dissatisfied").cast("double"))).alias("target_dissatisfaction"),
        F.avg(F.when(of, F.col("delivered_late").cast("double"))).alias("target_late_rate"),
    )


def root_cause(
    reviews: DataFrame, dim: str, lines: DataFrame | None = None, min_target: int = 20
) -> DataFrame:
    """Where a theme concentrates: per value of `dim` its share of reviews and the lift over the overall share.

    With `lines` (order-level context such as category or seller) a review counts
    once for each distinct value of its order, and the rates are over target
    reviews; a dimension of the review itself gives rates over all its reviews.
    """
    overall = reviews.agg(
        ratio(count_when(F.col("is_target_theme")), F.count(F.lit(1))).alias("__overall")
    )
    rows = reviews
    if lines is not None:
        values = lines.filter(F.col(dim).isNotNull()).select("order_id", dim).distinct()
        rows = reviews.drop(dim).join(values, "order_id")
    table = _concentration(rows, dim, everyone=lines is None).filter(F.col("target_theme_count") >= min_target)
    share = ratio(F.col("target_theme_count"), F.col("review_count"))
    return table.crossJoin(F.broadcast(overall)).withColumns(
        {"target_theme_share": share, "theme_share_lift": ratio(share, F.col("__overall"))}
    ).drop("__overall").orderBy(F.desc("theme_share_lift"), F.desc("target_theme_count"), dim)


def delivery_comparison(reviews: DataFrame, all_name: str = "All reviews", target_name: str = "Target theme reviews", **limits: int) -> DataFrame:
    """Delivery delay and late rate: all reviews against those of the target theme."""
    groups = F.when(
        F.col("is_target_theme"), F.array(F.lit(all_name), F.lit(target_name))
    ).otherwise(F.array(F.lit(all_name)))
    rows = reviews.select("delivery_delay_days", "delivered_late", F.explode(groups).alias("group"))
    table = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg("delivery_delay_days").alias("mean_delivery_delay_days"),
        F.avg(F.col("delivered_late").cast("double")).alias("late_delivery_rate"),
    )
    medians = quantile_columns(rows, {"median_delivery_delay_days": ("delivery_delay_days", 0.5)}, "group", **limits)
    return table.join(medians, "group", "left")


def status_crosscheck(reviews: DataFrame) -> DataFrame:
    """Order status by target theme: volume, dissatisfaction, late rate."""
    return reviews.groupBy("order_status", "is_target_theme").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg(F.col("is_dissatisfied").cast("double")).alias("dissatisfaction_rate"),
        F.avg(F.col("delivered_late").cast("double")).alias("late_delivery_rate"),
    )


# --- records --------------------------------------------------------------------------------------


def evidence(reps: DataFrame, n: int = 5, label: str = "cluster") -> DataFrame:
    """The first n representative texts per cluster as one array; blank texts among them are left out."""
    first = reps.filter(F.col("rank") <= n)
    review = F.struct(
        F.col("review_id").cast("string").alias("review_id"), F.col("order_id").cast("string").alias("order_id"),
        F.col("review_score").cast("long").alias("review_score"), F.trim("review_text").alias("text"),
    )
    return first.groupBy(label).agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.trim("review_text") != "", F.struct("rank", review.alias("review"))))),
            lambda r: r["review"],
        ).alias("representative_reviews")
    )


def decision_records(
    alerts: DataFrame, reps: DataFrame, period: str = "month", theme: str = "semantic_theme_cluster", label: str = "cluster",
    dataset: str = "Customer review dataset", min_reviews: int = 100,
) -> DataFrame:
    """One nested record per HIGH alert, with up to five representative reviews as evidence.

    `min_reviews` is the threshold that `theme_alerts` used.
    """
    high = alerts.filter(F.col("alert_level") == "HIGH")
    with_proof = join_groups(high, evidence(reps, label=label).withColumnRenamed(label, theme), [theme], "left")
    month = F.date_format(period, "yyyy-MM")
    signal = F.struct(
        month.alias("month"), F.col(theme).alias("theme_cluster"), "theme_name", "review_count", "theme_share",
        "baseline_share", "share_deviation", "share_z_score",
        F.col("theme_dissatisfaction_rate").alias("dissatisfaction_rate"),
        F.col("baseline_dissatisfaction").alias("baseline_dissatisfaction_rate"),
        "dissatisfaction_change", "priority_score", "alert_level",
    )
    empty = F.array().cast("array<struct<review_id:string,order_id:string,review_score:bigint,text:string>>")
    proof = F.struct(
        F.lit("Trailing 6-month theme baseline").alias("historical_baseline"),
        F.lit(min_reviews).alias("minimum_review_threshold"),
        F.coalesce("representative_reviews", empty).alias("representative_reviews"),
    )
    return with_proof.select(
        record_id("VOC-%s-CLUSTER-%s", month, F.col(theme).cast("string")).alias("decision_id"),
        F.lit("VOC_THEME_ALERT").alias("decision_type"),
        F.lit("REVIEW_REQUIRED").alias("status"),
        F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit("Customer Reviews / Voice of Customer").alias("domain"),
            F.lit("Monthly semantic theme review observations").alias("analytical_grain"),
        ).alias("source"),
        signal.alias("signal"),
        proof.alias("evidence"),
        F.lit(RECORD_ACTION).alias("recommended_action"),
        F.lit(RECORD_BOUNDARY).alias("analytical_boundary"),
        F.array(*[F.lit(s) for s in NEXT_STEPS]).alias("next_investigation"),
    )


def _pct4(col: str) -> Column:
    return F.round(F.col(col) * 100, 4)


def _num4(col: str) -> Column:
    return F.round(F.col(col), 4)


def top_leads(leads: DataFrame, dim: str, name: str, n: int = 5, min_target: int = 20) -> DataFrame:
    """The n strongest values of a dimension by lift, then volume, in report units."""
    ranked = leads.filter(F.col("target_theme_count") >= min_target).orderBy(
        F.desc("theme_share_lift"), F.desc("target_theme_count"), F.col(dim).asc()
    ).limit(n)
    return ranked.select(
        F.lit(name).alias("dimension"), F.col(dim).cast("string").alias("value"), "review_count", "target_theme_count",
        _pct4("target_theme_share").alias("target_theme_share_pct"), _num4("theme_share_lift").alias("theme_share_lift"),
        _pct4("target_dissatisfaction").alias("target_dissatisfaction_pct"),
        _pct4("target_late_rate").alias("target_late_delivery_pct"),
    )


LEADS = {
    "product_categories": "product_category_name", "sellers": "seller_id", "customer_geographies": "customer_state",
}


def investigation_leads(leads: Mapping[str, DataFrame], n: int = 5) -> DataFrame:
    """Top leads of every dimension in one table, ranked within it."""
    table = union_all(*[top_leads(leads[name], dim, name, n) for name, dim in LEADS.items()])
    # at most n rows per dimension are ranked
    order = Window.partitionBy("dimension").orderBy(F.desc("theme_share_lift"), F.desc("target_theme_count"), "value")
    return table.withColumn("rank", F.row_number().over(order))


def investigation_summary(
    alert: DataFrame, leads: Mapping[str, DataFrame], delivery: DataFrame, status: DataFrame, period: str = "month",
    theme: str = "semantic_theme_cluster",
) -> DataFrame:
    """The nested summary of one alert: signal, delivery and status evidence, leads per dimension."""
    table = investigation_leads(leads)
    lead_fields = [c for c in table.columns if c not in ("dimension", "rank")]
    packed = table.agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("dimension") == name, F.struct("rank", F.struct(*lead_fields).alias("lead"))))),
                lambda r: r["lead"],
            ).alias(name)
            for name in LEADS
        ]
    )
    deliveries = delivery.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "group", "review_count", _num4("mean_delivery_delay_days").alias("mean_delivery_delay_days"),
                    _num4("median_delivery_delay_days").alias("median_delivery_delay_days"),
                    _pct4("late_delivery_rate").alias("late_delivery_rate_pct"),
                )
            )
        ).alias("delivery")
    )
    states = status.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "order_status", "review_count", "target_theme_count",
                    _pct4("target_theme_share").alias("target_theme_share_pct"),
                    _num4("theme_share_lift").alias("theme_share_lift"),
                    _pct4("target_dissatisfaction").alias("target_dissatisfaction_pct"),
                    _pct4("target_late_rate").alias("target_late_delivery_pct"),
                )
            )
        ).alias("order_status")
    )
    month = F.date_format(period, "yyyy-MM")
    whole = alert
    for part in (packed, deliveries, states):
        whole = whole.crossJoin(F.broadcast(part))
    return whole.select(
        record_id("VOC-%s-CLUSTER-%s", month, F.col(theme).cast("string")).alias("decision_id"),
        F.lit("VOC_ROOT_CAUSE_INVESTIGATION").alias("decision_type"),
        F.lit("INVESTIGATION_REQUIRED").alias("status"),
        F.struct(
            month.alias("month"), F.col(theme).alias("theme_cluster"), "theme_name", "alert_level", "review_count",
            _pct4("theme_share").alias("theme_share_pct"), _pct4("baseline_share").alias("baseline_share_pct"),
            _num4("share_z_score").alias("share_z_score"),
            _pct4("theme_dissatisfaction_rate").alias("dissatisfaction_pct"),
            _pct4("baseline_dissatisfaction").alias("baseline_dissatisfaction_pct"),
            _pct4("dissatisfaction_change").alias("dissatisfaction_change_pct_points"),
            _num4("priority_score").alias("priority_score"),
        ).alias("alert"),
        F.struct("delivery", "order_status").alias("operational_evidence"),
        F.struct(*LEADS).alias("investigation_leads"),
        F.concat(
            F.array(F.concat(F.lit("Investigate delivery performance for the "), F.date_format(period, "MMMM yyyy"), F.lit(" period."))),
            F.array(*[F.lit(s) for s in SUMMARY_ACTIONS]),
        ).alias("recommended_action"),
        F.lit("NOT_ESTABLISHED").alias("causal_status"),
        F.lit(SUMMARY_BOUNDARY).alias("analytical_boundary"),
    )
