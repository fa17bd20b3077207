"""Point-in-time retention features: cutoffs, order-level facts, features, labels, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.dates import days_to_four_places, month_end_list, month_label, whole_days
from basketry.functions.values import count_when, pct, positive_ratio, ratio
from basketry.operators.aggregates import summary_row
from basketry.operators.joins import (
    along_cutoffs, attach_cutoffs, fill_forward_cutoffs, first_cutoff_index, happens_within, has_repeats, has_repeats_among, run_forward,
)

KEY, SNAPSHOT, TARGET = "customer_unique_id", "snapshot_timestamp", "repeat_purchase_90d"
TIME = "order_purchase_timestamp"

# The 22 model features, in contract order.
FEATURES = [
    "orders_to_date", "total_spend_to_date", "total_order_items_to_date", "unique_products_to_date",
    "unique_categories_to_date", "unique_sellers_to_date", "recency_days", "average_order_value",
    "average_items_per_order", "orders_30d", "spend_30d", "items_30d", "orders_60d", "spend_60d", "items_60d",
    "orders_90d", "spend_90d", "items_90d", "average_review_score_to_date", "payment_observation_available",
    "review_observation_available", "item_observation_available",
]
# The second feature set and its reduced form.
V2_FEATURES = [
    "orders_to_date", "total_spend_to_date", "unique_products_to_date", "unique_categories_to_date",
    "unique_sellers_to_date", "recency_days", "average_review_score_to_date", "orders_30d_share",
    "orders_60d_share", "orders_90d_share", "spend_30d_share", "spend_60d_share", "spend_90d_share",
    "orders_30d_velocity", "orders_60d_velocity", "orders_90d_velocity", "spend_30d_velocity",
    "spend_60d_velocity", "spend_90d_velocity", "spend_per_order_item", "recent_activity_90d",
]
REDUCED_FEATURES = [
    "orders_to_date", "total_spend_to_date", "unique_products_to_date", "unique_categories_to_date",
    "unique_sellers_to_date", "recency_days", "average_review_score_to_date", "orders_90d", "spend_90d",
    "orders_90d_share", "spend_90d_velocity", "spend_per_order_item",
]
HORIZONS = [30, 60, 90, 120, 180, 270, 365]


def _identity(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", KEY).distinct()


def _owned(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.join(_identity(customers).filter(F.col(KEY).isNotNull()), "customer_id")


def customer_history(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Per customer: first and last purchase and the follow-up left after the last one."""
    seen = _owned(orders, customers).filter(F.col(TIME).isNotNull()).groupBy(KEY).agg(
        F.min(TIME).alias("first_purchase"),
        F.max(TIME).alias("last_purchase"),
        F.countDistinct("order_id").alias("total_orders"),
    )
    end = orders.agg(F.max(TIME).alias("dataset_end"))
    return seen.crossJoin(F.broadcast(end)).withColumn(
        "days_available_after_last_purchase", whole_days(F.col("dataset_end"), F.col("last_purchase"))
    ).drop("dataset_end")


def temporal_coverage(orders: DataFrame, customers: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Per horizon: customers with at least that many days of follow-up. One pass counts all horizons."""
    history = customer_history(orders, customers)
    left = F.col("days_available_after_last_purchase")
    row = history.agg(
        F.count(F.lit(1)).alias("__n"), *[count_when(left >= h).alias(f"h{h}") for h in horizons]
    )
    cells = F.array(
        *[F.struct(F.lit(h).alias("horizon_days"), F.col(f"h{h}").alias("eligible_customers")) for h in horizons]
    )
    return row.select("__n", F.inline(cells)).select(
        "horizon_days", "eligible_customers", pct(F.col("eligible_customers"), F.col("__n")).alias("eligible_pct")
    )


def last_purchase_months(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers per month of their last purchase."""
    history = customer_history(orders, customers)
    return history.groupBy(month_label(F.col("last_purchase")).alias("last_purchase_month")).agg(
        F.count(F.lit(1)).alias("customers")
    )


def snapshot_cutoffs(orders: DataFrame, horizon: int = 90, history: int = 90) -> DataFrame:
    """Month-end midnights that leave `history` days before and `horizon` days after them."""
    bounds = orders.agg(
        F.date_add(F.to_date(F.min(TIME)), history).alias("a"), F.date_sub(F.to_date(F.max(TIME)), horizon).alias("b")
    )
    kind = dict(orders.dtypes)[TIME]
    inside = bounds.filter("a <= b")
    ends = F.transform(month_end_list(F.col("a"), F.col("b")), lambda d: d.cast(kind))
    return inside.select(F.explode(ends).alias("cutoff_timestamp"))


def snapshot_design(orders: DataFrame, customers: DataFrame, horizon: int = 90, history: int = 90) -> DataFrame:
    """Per cutoff: customers with history, those of them buying within the horizon, and the rate.

    Orders at the cutoff midnight count as history, later ones of that day do not.
    """
    cutoffs = snapshot_cutoffs(orders, horizon, history)
    owned = _owned(orders, customers).select(KEY, TIME)
    first = owned.groupBy(KEY).agg(F.min(TIME).alias(TIME))
    placed = attach_cutoffs(first, cutoffs).withColumn("at", first_cutoff_index(F.col(TIME)))
    new = placed.filter(F.col("at") < F.size("cutoffs")).groupBy("at").agg(
        F.count(F.lit(1)).alias("customers_with_history")
    )
    known = fill_forward_cutoffs(new, [], ["customers_with_history"], cutoffs).select(
        F.col("cutoff").alias("cutoff_timestamp"), "customers_with_history"
    )
    returning = (
        happens_within(owned, cutoffs, KEY, TIME, horizon)
        .join(first.select(KEY, F.col(TIME).alias("__first")), KEY)
        .filter(F.col("__first") <= F.col("cutoff_timestamp"))
        .groupBy("cutoff_timestamp")
        .agg(F.count(F.lit(1)).alias("customers_with_future_purchase"))
    )
    table = (
        cutoffs.join(known, "cutoff_timestamp", "left")
        .join(returning, "cutoff_timestamp", "left")
        .na.fill(0, ["customers_with_history", "customers_with_future_purchase"])
    )
    return table.select(
        "cutoff_timestamp",
        (F.col("cutoff_timestamp") + F.make_dt_interval(F.lit(horizon))).alias("future_window_end"),
        "customers_with_history",
        "customers_with_future_purchase",
        ratio(100.0 * F.col("customers_with_future_purchase"), F.col("customers_with_history"), on_zero=0.0).alias(
            "repeat_purchase_90d_rate"
        ),
    ).orderBy("cutoff_timestamp")


def categorized_items(items: DataFrame, products: DataFrame) -> DataFrame:
    return items.select("order_id", "order_item_id", "product_id", "seller_id").join(
        products.select("product_id", "product_category_name"), "product_id", "left"
    )


def _dated_orders(orders: DataFrame, customers: DataFrame, *more: str) -> DataFrame:
    """The rows of `order_level` without what is joined to them: order, customer and purchase time."""
    return orders.join(_identity(customers), "customer_id", "left").select("order_id", KEY, TIME, *more)


def order_level(
    orders: DataFrame, items: DataFrame, payments: DataFrame, reviews: DataFrame, products: DataFrame, customers: DataFrame
) -> DataFrame:
    """One row per order; payments, items and reviews are each combined per order before they are joined."""
    paid = payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_value"), F.count("payment_sequential").alias("payment_records")
    )
    lines = categorized_items(items, products).groupBy("order_id").agg(
        F.count("order_item_id").alias("order_item_count"),
        F.countDistinct("product_id").alias("unique_products"),
        F.countDistinct("product_category_name").alias("unique_categories"),
        F.countDistinct("seller_id").alias("unique_sellers"),
    )
    rated = reviews.groupBy("order_id").agg(
        F.count("review_id").alias("review_count"), F.avg("review_score").alias("average_review_score")
    )
    base = _dated_orders(orders, customers, "order_status")
    whole = base.join(paid, "order_id", "left").join(lines, "order_id", "left").join(rated, "order_id", "left")
    return whole.withColumns(
        {
            "payment_observed": F.col("payment_value").isNotNull().cast("int"),
            "review_observed": F.col("review_count").isNotNull().cast("int"),
            "item_observed": F.col("order_item_count").isNotNull().cast("int"),
        }
    )


def _review_steps(owned: DataFrame, reviews: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Review totals by the cutoff that first sees each review, not by the order's own.

    An order counts with the mean of its reviews seen so far, so each further
    review adds the change of that mean. A window sees at most one row per cutoff of an order.
    """
    dated = reviews.select("order_id", "review_id", "review_score", "review_creation_date").join(
        owned.select("order_id", KEY, TIME), "order_id"
    )
    placed = attach_cutoffs(dated, cutoffs).withColumn(
        "at", first_cutoff_index(F.greatest(F.col(TIME), F.col("review_creation_date")))
    )
    steps = placed.filter(F.col("at") < F.size("cutoffs")).groupBy(KEY, "order_id", "at").agg(
        F.count("review_id").alias("n"), F.sum("review_score").alias("s"), F.count("review_score").alias("c")
    )
    over = Window.partitionBy(KEY, "order_id").orderBy("at")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    mean = steps.withColumn("mean", F.try_divide(F.sum("s").over(upto).cast("double"), F.sum("c").over(upto)))
    before = F.lag("mean").over(over)
    return mean.select(
        KEY,
        "at",
        F.when(F.lag("at").over(over).isNull(), 1).otherwise(0).alias("rev_obs"),
        F.col("n").alias("rev_count"),
        (F.coalesce("mean", F.lit(0.0)) - F.coalesce(before, F.lit(0.0))).alias("score_sum"),
        (F.col("mean").isNotNull().cast("int") - before.isNotNull().cast("int")).alias("score_n"),
    )


def point_in_time(
    order_table: DataFrame,
    items: DataFrame,
    cutoffs: DataFrame,
    trailing: Sequence[int] = (30, 60, 90),
    label_days: int = 90,
    strict_asof: bool = False,
    reviews: DataFrame | None = None,
    dated_orders: DataFrame | None = None,
) -> DataFrame:
    """Features and forward label per customer and cutoff, without missing-value treatment."""
    steps = point_in_time_steps(order_table, items, cutoffs, trailing, label_days, strict_asof, reviews, dated_orders)
    return point_in_time_rows(steps, cutoffs, trailing)


def point_in_time_steps(
    order_table: DataFrame,
    items: DataFrame,
    cutoffs: DataFrame,
    trailing: Sequence[int] = (30, 60, 90),
    label_days: int = 90,
    strict_asof: bool = False,
    reviews: DataFrame | None = None,
    dated_orders: DataFrame | None = None,
) -> DataFrame:
    """`point_in_time` as stretches: one row per customer and run of cutoffs that share the running totals, from index `at` up to `next_at`.

    Every fact is placed on the cutoffs it newly affects: history totals on the
    first cutoff that sees the order, trailing windows and the label on the few
    cutoffs near it. Those rows are combined per (customer, cutoff) and history is
    then run forward, so orders are never copied to all later cutoffs. Distinct
    products, categories and sellers are counted where they are first seen.

    Reviews enter with their order's purchase time; `strict_asof` (with `reviews`)
    lets each review in only from its own creation date. `dated_orders` are the same orders with key and time alone: with them,
    items find their customer without the order table's joins being run a second time.
    """
    known = F.col(KEY).isNotNull() & F.col(TIME).isNotNull()
    owned = order_table.filter(known)
    bare = (order_table if dated_orders is None else dated_orders).filter(known).select("order_id", KEY, TIME)
    dated = attach_cutoffs(owned, cutoffs)
    time, longest = F.col(TIME), max(trailing)

    def days(n: int) -> Column:
        return F.make_dt_interval(F.lit(n))

    def before(moment: Column) -> Column:
        """How many cutoffs lie before a moment."""
        return F.size(F.filter("cutoffs", lambda c: c < moment))

    # cutoffs within reach of the label or of a trailing window, and the first one that sees the order
    dated = dated.filter(F.size("cutoffs") > 0).withColumns(
        {"first_at": first_cutoff_index(time), "low": before(time - days(label_days)), "high": before(time + days(longest))}
    )
    none = F.array().cast("array<int>")
    near = F.concat(
        F.when(F.col("low") < F.col("high"), F.sequence("low", F.col("high") - 1)).otherwise(none),
        F.when((F.col("first_at") >= F.col("high")) & (F.col("first_at") < F.size("cutoffs")), F.array("first_at")).otherwise(none),
    )
    spread = dated.withColumn("at", F.explode(near)).withColumn("cutoff", F.get("cutoffs", F.col("at")))
    enters, seen = F.col("at") == F.col("first_at"), F.col("cutoff") >= time

    def on_entry(value: Column) -> Column:
        return F.when(enters, value)

    history = {
        "orders": on_entry(F.lit(1)),
        "spend": on_entry(F.col("payment_value")),
        "items": on_entry(F.col("order_item_count")),
        "pay_records": on_entry(F.col("payment_records")),
        "pay_obs": on_entry(F.col("payment_observed")),
    }
    review_history = {
        "rev_obs": on_entry(F.col("review_observed")),
        "rev_count": on_entry(F.col("review_count")),
        "score_sum": on_entry(F.col("average_review_score")),
        "score_n": on_entry(F.col("average_review_score").isNotNull().cast("int")),
    }
    window = {}
    for d in trailing:
        recent = seen & (time > F.col("cutoff") - days(d))
        window[f"orders_{d}d"] = F.when(recent, 1)
        window[f"spend_{d}d"] = F.when(recent, F.col("payment_value"))
        window[f"items_{d}d"] = F.when(recent, F.col("order_item_count"))
    local = {**window, "future": F.when(~seen, 1)}

    def totals(names) -> list[Column]:
        return [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]

    in_orders = {**history, **({} if strict_asof else review_history), **local}
    facts = spread.select(KEY, "at", F.when(enters, time).alias("bought"), *[v.alias(n) for n, v in in_orders.items()])

    # where is each product, category and seller of a customer first seen?
    things = F.array(
        *[
            F.struct(F.lit(kind).cast("tinyint").alias("kind"), F.col(col).cast("string").alias("thing"))
            for kind, col in enumerate(("product_id", "product_category_name", "seller_id"))
        ]
    )
    # an order's cutoff is found before its lines are joined, so the list is searched once per order and not once per thing
    entered = attach_cutoffs(bare, cutoffs).withColumn("at", first_cutoff_index(time))
    entered = entered.filter(F.col("at") < F.size("cutoffs")).select("order_id", KEY, "at")
    lines = items.select("order_id", "product_id", "product_category_name", "seller_id")
    firsts = (
        lines.join(entered, "order_id")
        .select(KEY, "at", F.inline(things))
        .filter(F.col("thing").isNotNull())
        .groupBy(KEY, "kind", "thing")
        .agg(F.min("at").alias("at"))
    )
    kinds = ["products", "categories", "sellers"]
    firsts = firsts.select(KEY, "at", *[(F.col("kind") == i).cast("int").alias(k) for i, k in enumerate(kinds)])
    # one grouping takes all contributions: combined in each task, then shuffled by customer once
    steps = facts.unionByName(firsts, allowMissingColumns=True)
    if strict_asof:
        if reviews is None:
            raise ValueError("strict_asof needs the reviews with their creation date")
        steps = steps.unionByName(_review_steps(bare, reviews, cutoffs), allowMissingColumns=True)

    running = [*history, *review_history, *kinds]
    merged = steps.groupBy(KEY, "at").agg(F.max("bought").alias("bought"), *totals([*running, *local]))
    steps_run = run_forward(merged, [KEY], running, latest=["bought"]).filter(F.col("orders") > 0)
    last = F.col("bought")

    def to_date_names() -> dict[str, str]:
        return {
            "orders": "orders_to_date", "spend": "total_spend_to_date", "items": "total_order_items_to_date",
            "products": "unique_products_to_date", "categories": "unique_categories_to_date",
            "sellers": "unique_sellers_to_date", "pay_records": "total_payment_records_to_date",
            "pay_obs": "payment_observations_to_date", "rev_obs": "review_observations_to_date",
            "rev_count": "total_review_count_to_date",
        }

    # what a stretch of cutoffs shares is worked out before the stretch is spread, and only the rest per row
    shared = {
        **{out: F.col(n) for n, out in to_date_names().items()},
        "average_review_score_to_date": F.try_divide(F.col("score_sum").cast("double"), F.col("score_n")),
        "last_purchase_timestamp": last,
        "average_order_value": F.try_divide(F.col("spend").cast("double"), F.col("orders")),
        "average_items_per_order": F.try_divide(F.col("items").cast("double"), F.col("orders")),
    }
    return steps_run.select(KEY, "at", "next_at", *[v.alias(n) for n, v in shared.items()], *local)


def point_in_time_rows(steps: DataFrame, cutoffs: DataFrame, trailing: Sequence[int] = (30, 60, 90)) -> DataFrame:
    """The rows of `point_in_time` from its stretches."""
    window = [f"{kind}_{d}d" for d in trailing for kind in ("orders", "spend", "items")]
    names = [c for c in steps.columns if c not in {KEY, "at", "next_at", "future", *window}]
    filled = along_cutoffs(steps, cutoffs)
    here, cutoff = F.col("age") == 0, F.col("cutoff")
    recency = days_to_four_places(cutoff, F.col("last_purchase_timestamp"))
    spot = names.index("average_order_value")
    return filled.select(
        KEY,
        cutoff.alias(SNAPSHOT),
        *names[:spot],
        recency.alias("recency_days"),
        *names[spot:],
        *[F.when(here, F.col(n)).otherwise(F.lit(0)).alias(n) for n in window],
        F.when(here & (F.col("future") > 0), 1).otherwise(0).alias(TARGET),
    )


def forward_label(order_table: DataFrame, cutoffs: DataFrame, days: int = 90) -> DataFrame:
    """Per customer with history at a cutoff: did they buy again within (cutoff, cutoff + days]?"""
    owned = order_table.filter(F.col(KEY).isNotNull())
    first = attach_cutoffs(owned.groupBy(KEY).agg(F.min(TIME).alias(TIME)), cutoffs)
    population = first.select(
        KEY, F.explode(F.filter("cutoffs", lambda c: c >= F.col(TIME))).alias("cutoff_timestamp")
    )
    hits = happens_within(owned, cutoffs, KEY, TIME, days).withColumn("__hit", F.lit(1))
    return population.join(hits, [KEY, "cutoff_timestamp"], "left").select(
        KEY, "cutoff_timestamp", F.coalesce("__hit", F.lit(0)).alias(TARGET)
    )


def training_table(
    tables: Mapping[str, DataFrame], cutoffs: DataFrame, validate: bool = False, **options
) -> DataFrame:
    """Point-in-time features with zero fill and availability flags, one row per customer and cutoff."""
    return training_rows(training_steps(tables, cutoffs, **options), cutoffs, validate)


def training_steps(tables: Mapping[str, DataFrame], cutoffs: DataFrame, **options) -> DataFrame:
    """The training table as stretches of cutoffs, for storing: a customer has one for each cutoff near an order, and one for all others up to the next order."""
    order_table = order_level(
        tables["orders"], tables["items"], tables["payments"], tables["reviews"], tables["products"], tables["customers"]
    )
    lines = categorized_items(tables["items"], tables["products"])
    if options.get("strict_asof"):
        options.setdefault("reviews", tables["reviews"])
    dated_orders = _dated_orders(tables["orders"], tables["customers"])
    return point_in_time_steps(order_table, lines, cutoffs, dated_orders=dated_orders, **options)


def training_rows(steps: DataFrame, cutoffs: DataFrame, validate: bool = False) -> DataFrame:
    """The rows of the training table from its stretches; nothing is shuffled."""
    raw = point_in_time_rows(steps, cutoffs)
    keep = {KEY, SNAPSHOT, "last_purchase_timestamp"}
    filled = raw.select(*[F.col(c) if c in keep else F.coalesce(F.col(c), F.lit(0)).alias(c) for c in raw.columns])
    table = filled.withColumns(
        {
            "payment_observation_available": (F.col("payment_observations_to_date") > 0).cast("int"),
            "review_observation_available": (F.col("review_observations_to_date") > 0).cast("int"),
            "item_observation_available": (F.col("total_order_items_to_date") > 0).cast("int"),
        }
    )
    if validate:
        if has_repeats(table, [KEY, SNAPSHOT]):
            raise ValueError("a customer occurs twice at one snapshot")
        if not table.filter((F.col("recency_days") < 0) | ~F.col(TARGET).isin(0, 1)).limit(1).isEmpty():
            raise ValueError("negative recency or a label other than 0/1")
    return table


def ratio_features(training: DataFrame) -> DataFrame:
    """Shares of recent activity, velocities, spend per item, activity flag; a zero denominator gives 0.0."""
    added: dict[str, Column] = {}
    for d in (30, 60, 90):
        added[f"orders_{d}d_share"] = positive_ratio(F.col(f"orders_{d}d"), F.col("orders_to_date"))
        added[f"spend_{d}d_share"] = positive_ratio(F.col(f"spend_{d}d"), F.col("total_spend_to_date"))
        added[f"orders_{d}d_velocity"] = F.col(f"orders_{d}d") / F.lit(float(d))
        added[f"spend_{d}d_velocity"] = F.col(f"spend_{d}d") / F.lit(float(d))
    added["spend_per_order_item"] = positive_ratio(F.col("total_spend_to_date"), F.col("total_order_items_to_date"))
    added["recent_activity_90d"] = (F.col("orders_90d") > 0).cast("int")
    return training.withColumns(added)


def reduced_features(v2: DataFrame, validate: bool = False) -> DataFrame:
    """Keys, label and the reduced feature set."""
    reduced = v2.select(KEY, SNAPSHOT, TARGET, *REDUCED_FEATURES)
    if validate:
        bad = ~F.col(TARGET).isin(0, 1)
        for f in REDUCED_FEATURES:
            bad = bad | F.col(f).isNull() | (F.col(f) < 0)
        if has_repeats_among(reduced, KEY, SNAPSHOT) or not reduced.filter(bad).limit(1).isEmpty():
            raise ValueError("reduced features: repeated keys, missing or negative values")
    return reduced


def temporal_split(df: DataFrame, time: str, train_end: str, valid_end: str, name: str = "split") -> DataFrame:
    """train up to and including `train_end`, validation up to `valid_end`, test after it. Every dated row gets a split."""
    kind = dict(df.dtypes)[time]
    a, b = F.lit(train_end).cast(kind), F.lit(valid_end).cast(kind)
    return df.withColumn(
        name,
        F.when(F.col(time) <= a, "train").when(F.col(time) <= b, "validation").when(F.col(time) > b, "test"),
    )


def split_summary(split: DataFrame, name: str = "split") -> DataFrame:
    """Range, rows, customers, positives and rate per split."""
    return split.groupBy(name).agg(
        F.min(SNAPSHOT).alias("first_snapshot"),
        F.max(SNAPSHOT).alias("last_snapshot"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(KEY).alias("unique_customers"),
        F.sum(TARGET).alias("positives"),
    ).withColumn("positive_rate_pct", pct(F.col("positives"), F.col("rows")))


def target_by_snapshot(training: DataFrame) -> DataFrame:
    """Customers, positives and rate per snapshot."""
    return training.groupBy(SNAPSHOT).agg(
        F.count(F.lit(1)).alias("customers"), F.sum(TARGET).alias("positive_targets")
    ).withColumn("positive_rate_pct", pct(F.col("positive_targets"), F.col("customers")))


def class_balance(training: DataFrame) -> DataFrame:
    """Positives, negatives, rate and negatives per positive."""
    row = summary_row(
        training, {"positives": count_when(F.col(TARGET) == 1), "negatives": count_when(F.col(TARGET) != 1)}
    )
    return row.withColumns(
        {
            "positive_rate_pct": pct(F.col("positives"), F.col("positives") + F.col("negatives")),
            "negatives_per_positive": ratio(F.col("negatives"), F.col("positives")),
        }
    )

