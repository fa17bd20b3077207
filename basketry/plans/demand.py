"""Daily demand series: preparation, features, baselines, smoothing, trees, error tables.

Every function takes `by`, so many series run side by side. A series has one row
per day, which bounds each window and each collected series by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.dates import calendar_features, dow_monday0, month_label, weekday_name
from basketry.functions.values import count_when, pct, ratio
from basketry.operators.columns import drop_incomplete
from basketry.operators.joins import fill_calendar
from basketry.operators.ordering import as_list, join_groups, with_group_total
from basketry.operators.topk import top_n
from basketry.operators.windows import add_lags, add_trailing, time_index
from basketry.plans import boosting
from basketry.plans.boosting import BoostedTrees, Options

VALUE = "order_count"
LAGS = [1, 2, 3, 7, 14, 21, 28]
WINDOWS = [7, 14, 28]
STATS = ["mean", "std", "min", "max"]

CALENDAR_FEATURES = [
    "day_of_week", "day_of_month", "month", "quarter", "week_of_year", "is_weekend", "time_index",
]
LAG_FEATURES = [f"lag_{k}" for k in LAGS]
ROLLING_FEATURES = [f"rolling_{s}_{w}" for w in WINDOWS for s in STATS]
ALL_FEATURES = CALENDAR_FEATURES + LAG_FEATURES + ROLLING_FEATURES
FEATURE_SETS = {
    "A_lags_only": LAG_FEATURES,
    "B_lags_calendar": LAG_FEATURES + CALENDAR_FEATURES,
    "C_lags_calendar_rolling_means": LAG_FEATURES + CALENDAR_FEATURES + [f"rolling_mean_{w}" for w in WINDOWS],
    "D_full_v1": ALL_FEATURES,
}


def daily_counts(
    orders: DataFrame, by: str | Sequence[str] = (), time: str = "order_purchase_timestamp", id: str = "order_id"
) -> DataFrame:
    """Distinct orders per day and series, with a row for every day between first and last."""
    by = as_list(by)
    dated = orders.withColumn("date", F.to_date(time)).groupBy(*by, "date").agg(F.countDistinct(id).alias(VALUE))
    return fill_calendar(dated, "date", VALUE, by)


def demand_stats(daily: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Totals, moments, percentiles and zero-day share per series."""
    value = F.col(VALUE)
    ps = [0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99]
    table = daily.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(value).alias("total_orders"),
        F.avg(value).alias("mean_orders"),
        F.median(value).alias("median_orders"),
        F.stddev_samp(value).alias("std_orders"),
        F.min(value).alias("min_orders"),
        F.max(value).alias("max_orders"),
        F.percentile(value, F.array(*[F.lit(p) for p in ps])).alias("__q"),
        count_when(value == 0).alias("zero_days"),
        F.min(F.when(value == 0, F.col("date"))).alias("first_zero_date"),
        F.max(F.when(value == 0, F.col("date"))).alias("last_zero_date"),
    )
    named = {f"p{int(p * 100):02d}": F.element_at("__q", i + 1) for i, p in enumerate(ps)}
    return table.withColumns({**named, "zero_days_pct": pct(F.col("zero_days"), F.col("days"))}).drop("__q")


def weekday_profile(daily: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    return daily.groupBy(*as_list(by), weekday_name(F.col("date")).alias("day_of_week")).agg(
        F.count(VALUE).alias("days"),
        F.avg(VALUE).alias("mean_orders"),
        F.median(VALUE).alias("median_orders"),
        F.stddev_samp(VALUE).alias("std_orders"),
    )


def monthly_profile(daily: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    return daily.groupBy(*as_list(by), month_label(F.col("date")).alias("year_month")).agg(
        F.count(VALUE).alias("days"),
        F.sum(VALUE).alias("total_orders"),
        F.avg(VALUE).alias("mean_orders"),
        F.median(VALUE).alias("median_orders"),
    )


def extreme_days(daily: DataFrame, n: int = 10) -> DataFrame:
    """The n busiest days and the n quietest days with any demand."""
    top = top_n(daily.select("date", VALUE), VALUE, n, "date").withColumn("kind", F.lit("top"))
    low = top_n(daily.filter(F.col(VALUE) > 0).select("date", VALUE), VALUE, n, "date", ascending=True)
    return top.unionByName(low.withColumn("kind", F.lit("bottom")))


def modelling_window(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Days within [start, end]."""
    return daily.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def window_coverage(daily: DataFrame, start: str, end: str) -> DataFrame:
    """What the modelling window keeps and what it leaves out."""
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return daily.groupBy(F.when(inside, "modelling").otherwise("excluded").alias("part")).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(VALUE).alias("total_orders"),
        F.avg(VALUE).alias("mean_orders"),
        F.median(VALUE).alias("median_orders"),
        count_when(F.col(VALUE) == 0).alias("zero_days"),
    )


def demand_features(daily: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Calendar, index, lag and trailing features; rows without 28 earlier days are dropped.

    All windows share one partitioning and order, so the series is shuffled and sorted once.
    """
    table = time_index(calendar_features(daily, "date"), "date", by)
    table = add_lags(table, VALUE, LAGS, by)
    table = add_trailing(table, VALUE, WINDOWS, STATS, by)
    return drop_incomplete(table, ["lag_28", "rolling_mean_28", "rolling_std_28"])


def date_split(df: DataFrame, bounds: Mapping[str, tuple[str, str]], name: str = "split") -> DataFrame:
    """Split label by inclusive date bounds; days outside all of them are left out."""
    label = F.lit(None).cast("string")
    for split, (start, end) in bounds.items():
        inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        label = F.when(inside, F.lit(split)).otherwise(label)
    return df.withColumn(name, label).filter(F.col(name).isNotNull())


def date_split_summary(split: DataFrame, name: str = "split") -> DataFrame:
    return split.groupBy(name).agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("days"),
        F.sum(VALUE).alias("total_orders"),
        F.avg(VALUE).alias("mean_orders"),
    )


def baselines(daily: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """One-step-ahead naive, seasonal-naive and moving-average forecasts."""
    over = Window.partitionBy(*as_list(by)).orderBy("date")
    week = over.rowsBetween(-7, -1)
    return daily.withColumns(
        {
            "naive": F.lag(VALUE, 1).over(over).cast("double"),
            "seasonal_naive_7": F.lag(VALUE, 7).over(over).cast("double"),
            "moving_average_7": F.when(F.count(VALUE).over(week) == 7, F.avg(VALUE).over(week)),
        }
    )


BASELINES = ["naive", "seasonal_naive_7", "moving_average_7"]


def _ends(train: DataFrame, by: list[str]) -> DataFrame:
    """Per series: first and last value, length, last date."""
    value = F.col(VALUE).cast("double")
    return train.groupBy(*by).agg(
        F.min_by(value, "date").alias("y1"),
        F.max_by(value, "date").alias("yn"),
        F.count(F.lit(1)).alias("n"),
        F.max("date").alias("last_date"),
    ).withColumn("slope", F.coalesce(F.try_divide(F.col("yn") - F.col("y1"), F.col("n") - 1), F.lit(0.0)))


def _steps(df: DataFrame, horizon: int) -> DataFrame:
    ahead = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return ahead.withColumn("date", F.date_add("last_date", F.col("step")))


def _floored(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0)).alias("prediction")


def drift(train: DataFrame, horizon: int, by: str | Sequence[str] = ()) -> DataFrame:
    """Straight line through first and last value, floored at zero."""
    by = as_list(by)
    return _steps(_ends(train, by), horizon).select(
        *by, F.lit("drift").alias("model"), "step", "date", _floored(F.col("yn") + F.col("step") * F.col("slope"))
    )


def damped_drift(
    train: DataFrame, horizon: int, phis: Sequence[float] = (0.70, 0.80, 0.85, 0.90, 0.95), by: str | Sequence[str] = ()
) -> DataFrame:
    """Drift whose contribution decays; one forecast per damping factor."""
    by = as_list(by)
    ends = _ends(train, by).withColumn("phi", F.explode(F.array(*[F.lit(float(p)) for p in phis])))
    reach = (F.lit(1.0) - F.pow("phi", "step")) / (F.lit(1.0) - F.col("phi"))
    return _steps(ends, horizon).select(
        *by, F.concat(F.lit("damped_drift_"), F.col("phi").cast("string")).alias("model"), "step", "date",
        _floored(F.col("yn") + F.col("slope") * reach),
    )


def seasonal_drift(
    train: DataFrame, horizon: int, weights: Sequence[float] = (0.10, 0.25, 0.50, 0.75), by: str | Sequence[str] = (),
    season: int = 7,
) -> DataFrame:
    """Last season repeated, raised per season by a weighted trend (mean of last season − mean of the one before).

    The recursive definition has a closed form for non-negative history: each
    season adds the same amount to the value one season earlier, floored at zero.
    """
    by = as_list(by)
    sized = with_group_total(train, by, {"last_date": F.max("date"), "n": F.count(F.lit(1))})
    age = F.datediff("last_date", "date")
    recent = sized.filter(age < 2 * season).groupBy(*by, "last_date", "n").agg(
        F.avg(F.when(age < season, F.col(VALUE))).alias("recent"),
        F.avg(F.when(age >= season, F.col(VALUE))).alias("before"),
        F.max_by(F.col(VALUE).cast("double"), "date").alias("yn"),
        # the last season in date order: one array of `season` values
        F.array_sort(F.collect_list(F.when(age < season, F.struct("date", F.col(VALUE).cast("double").alias("y"))))).alias("tail"),
    )
    spread = recent.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    base = F.element_at("tail", (F.col("step") - 1) % season + 1)["y"]
    raised = base + F.ceil(F.col("step") / season) * F.col("weight") * (F.col("recent") - F.col("before"))
    return _steps(spread, horizon).select(
        *by, F.concat(F.lit("seasonal_naive_drift_"), F.col("weight").cast("string")).alias("model"), "step", "date",
        _floored(F.when(F.col("n") < season, F.col("yn")).otherwise(raised)),
    )


def weekday_adjusted(train: DataFrame, future: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Last value times the weekday's mean relative to the overall mean (1.0 for an unseen weekday)."""
    by = as_list(by)
    overall = train.groupBy(*by).agg(
        F.avg(VALUE).alias("overall"), F.max_by(F.col(VALUE).cast("double"), "date").alias("latest")
    )
    weekday = train.groupBy(*by, dow_monday0(F.col("date")).alias("dow")).agg(F.avg(VALUE).alias("weekday_mean"))
    days = join_groups(future.select(*by, "date").withColumn("dow", dow_monday0(F.col("date"))), overall, by)
    days = join_groups(days, weekday, [*by, "dow"], "left")
    factor = F.coalesce(F.try_divide(F.col("weekday_mean"), F.col("overall")), F.lit(1.0))
    return days.select(*by, F.lit("weekday_adjusted_naive").alias("model"), "date", _floored(F.col("latest") * factor))


# name: (trend, seasonal, damped)
SMOOTHING = {
    "additive_trend_seasonal": (True, True, False),
    "damped_additive_trend_seasonal": (True, True, True),
    "seasonal_only": (False, True, False),
    "trend_only": (True, False, False),
}


def smoothing_backtest(
    train: DataFrame,
    horizon: int,
    configs: Mapping[str, tuple[bool, bool, bool]] = SMOOTHING,
    by: str | Sequence[str] = (),
    grid: Sequence[float] = (0.05, 0.1, 0.2, 0.4, 0.7),
    phis: Sequence[float] = (0.9, 0.98),
    period: int = 7,
) -> DataFrame:
    """Additive exponential smoothing: for each series and configuration the grid point of least squared error, forecast.

    A series is one array, bounded by its days. Grid points are exploded next to
    it, so series × parameters spread over tasks, and each is one fold in the JVM.
    """
    by = as_list(by)
    series = train.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("date", F.col(VALUE).cast("double").alias("y")))).alias("__s"),
        F.max("date").alias("last_date"),
    ).withColumn("y", F.transform("__s", lambda s: s["y"])).drop("__s")
    points = [
        (name, a, b, g, p)
        for name, (trend, seasonal, damped) in configs.items()
        for a in grid
        for b in (grid if trend else [0.0])
        for g in (grid if seasonal else [0.0])
        for p in (phis if damped else [1.0])
    ]
    table = F.array(
        *[
            F.struct(
                F.lit(n).alias("model"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma"),
                F.lit(p).alias("phi"), F.lit(configs[n][0]).alias("trend"), F.lit(configs[n][1]).alias("seasonal"),
            )
            for n, a, b, g, p in points
        ]
    )
    runs = series.filter(F.size("y") >= 2 * period).select(*by, "y", "last_date", F.explode(table).alias("c"))
    runs = runs.select(*by, "y", "last_date", "c.*").repartition(*by, "model", "alpha", "beta", "gamma", "phi")

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)

    level0 = mean(F.slice("y", 1, period))
    slope0 = F.when(F.col("trend"), (mean(F.slice("y", period + 1, period)) - level0) / period).otherwise(0.0)
    season0 = F.transform(
        F.slice("y", 1, period), lambda v: F.when(F.col("seasonal"), v - level0).otherwise(F.lit(0.0))
    )
    runs = runs.withColumns({"l0": level0, "b0": slope0, "s0": season0})
    start = F.struct(
        F.col("l0").alias("l"), F.col("b0").alias("b"), F.col("s0").alias("s"), F.lit(0.0).alias("sse"), F.lit(0).alias("i")
    )

    def step(state: Column, y: Column) -> Column:
        at = state["i"] % period
        season = F.get(state["s"], at)
        drifted = state["l"] + F.col("phi") * state["b"]
        error = y - drifted - season
        level = F.col("alpha") * (y - season) + (1 - F.col("alpha")) * drifted
        trend = F.col("beta") * (level - state["l"]) + (1 - F.col("beta")) * F.col("phi") * state["b"]
        seasonal = F.transform(
            state["s"],
            lambda s, j: F.when((j == at) & F.col("seasonal"), F.col("gamma") * (y - level) + (1 - F.col("gamma")) * s).otherwise(s),
        )
        return F.struct(
            level.alias("l"), F.when(F.col("trend"), trend).otherwise(F.lit(0.0)).alias("b"), seasonal.alias("s"),
            (state["sse"] + error * error).alias("sse"), (state["i"] + 1).alias("i"),
        )

    fitted = runs.withColumn("fit", F.aggregate("y", start, step)).drop("y", "l0", "b0", "s0")
    chosen = fitted.groupBy(*by, "model").agg(
        F.min_by(
            F.struct("last_date", "phi", "alpha", "beta", "gamma", "fit"),
            F.struct(F.col("fit.sse"), "alpha", "beta", "gamma", "phi"),
        ).alias("best")
    ).select(*by, "model", "best.*")
    reach = F.when(F.col("phi") == 1.0, F.col("step").cast("double")).otherwise(
        F.col("phi") * (F.lit(1.0) - F.pow("phi", "step")) / (F.lit(1.0) - F.col("phi"))
    )
    ahead = F.col("fit.l") + reach * F.col("fit.b") + F.get("fit.s", (F.col("fit.i") + F.col("step") - 1) % period)
    return _steps(chosen, horizon).select(
        *by, "model", "alpha", "beta", "gamma", "phi", F.col("fit.sse").alias("sse"), "step", "date", _floored(ahead)
    )


def predictions_long(wide: DataFrame, models: Sequence[str], keep: Sequence[str], actual: str = VALUE) -> DataFrame:
    """One row per kept row and model: actual and predicted value."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("prediction")) for m in models])
    return wide.select(*keep, F.col(actual).cast("double").alias("actual"), F.inline(pairs))


def forecast_errors(preds: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """MAE, RMSE and evaluated days per group, over pairs where both values are known."""
    error = F.col("actual") - F.col("prediction")
    known = preds.filter(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
    return known.groupBy(*as_list(by)).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("evaluation_days")
    )


def with_errors(wide: DataFrame) -> DataFrame:
    """Signed and absolute error of the three baselines, weekday and month."""
    names = {"naive": "naive", "seasonal_naive": "seasonal_naive_7", "moving_average": "moving_average_7"}
    errors = {f"{n}_error": F.col(VALUE) - F.col(c) for n, c in names.items()}
    sizes = {f"{n}_abs_error": F.abs(e) for n, e in zip(names, errors.values())}
    return wide.withColumns(
        {**errors, **sizes, "weekday": weekday_name(F.col("date")), "month": month_label(F.col("date"))}
    )


def error_analysis(errors: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Mean demand, MAE and bias of each baseline per group (split, month, weekday)."""
    names = ["naive", "seasonal_naive", "moving_average"]
    return errors.groupBy(*as_list(by)).agg(
        F.count("date").alias("days"),
        F.avg(VALUE).alias("actual_mean"),
        *[F.avg(f"{n}_abs_error").alias(f"{n}_mae") for n in names],
        *[F.avg(f"{n}_error").alias(f"{n}_bias") for n in names],
    )


def champion_table(errors: DataFrame, reference: str = "naive", by: str | Sequence[str] = ()) -> DataFrame:
    """Models by MAE, with the difference to the reference model in percent."""
    by = as_list(by)
    base = errors.filter(F.col("model") == reference).select(*by, F.col("mae").alias("__base"))
    table = join_groups(errors, base, by, "left") if by else errors.crossJoin(F.broadcast(base))
    relative = ratio(100.0 * (F.col("mae") - F.col("__base")), F.col("__base"))
    return table.withColumn("mae_vs_reference_pct", relative).drop("__base").orderBy(*by, "mae", "model")


def tree_options(
    features: Sequence[str] = tuple(ALL_FEATURES), rounds: int = 500, depth: int = 5, child_weight: int = 5, rate: float = 0.03,
    patience: int | None = None, seed: int = 42,
) -> Options:
    """How a demand model is fitted."""
    return Options(tuple(features), rounds, depth, child_weight, rate, patience=patience, seed=seed)


def fit_demand_trees(train: DataFrame, valid: DataFrame | None = None, **options) -> BoostedTrees:
    """Boosted regression trees with the settings of `tree_options`; `valid` rows give the error per round and, with `patience`, the stop."""
    return boosting.fit(train, VALUE, tree_options(**options), held=valid)


def predict_demand(model: BoostedTrees, df: DataFrame, trees: int | None = None) -> DataFrame:
    """Predictions floored at zero."""
    return model.transform(df, trees).withColumn("prediction", F.greatest("prediction", F.lit(0.0)))


def importances(model: BoostedTrees, df: DataFrame) -> DataFrame:
    """Feature importance per column: a handful of numbers of the fitted model."""
    return df.sparkSession.createDataFrame(list(model.importances().items()), "feature string, importance double")


def _split_errors(models: Mapping[str, tuple[BoostedTrees, int | None]], train: DataFrame, valid: DataFrame) -> DataFrame:
    """One row per model: train and validation error."""
    both = train.withColumn("__split", F.lit("train")).unionByName(valid.withColumn("__split", F.lit("validation")))
    scored = boosting.predictions(models, both, ["__split", F.col(VALUE).cast("double").alias("actual")])
    errors = forecast_errors(scored.withColumn("prediction", F.greatest("prediction", F.lit(0.0))), ["model", "__split"])
    return errors.groupBy("model").pivot("__split", ["train", "validation"]).agg(F.first("mae").alias("mae"), F.first("rmse").alias("rmse"))


def sweep(grid: Mapping[str, Mapping], train: DataFrame, valid: DataFrame) -> DataFrame:
    """One row per experiment: train and validation error. An experiment is a set of `tree_options` arguments; all are fitted side by side."""
    options = [tree_options(**o) for o in grid.values()]
    models = boosting.fit_all(train, VALUE, options)
    facts = train.sparkSession.createDataFrame(
        [(name, len(o.features), len(m.trees)) for name, o, m in zip(grid, options, models)], "experiment string, feature_count int, trees int"
    )
    errors = _split_errors({name: (m, None) for name, m in zip(grid, models)}, train, valid).withColumnRenamed("model", "experiment")
    return F.broadcast(facts).join(errors, "experiment").orderBy("validation_mae", "experiment")


# Experiments of the parameter sweep.
PARAMETER_GRID = {
    "depth_3": {"depth": 3, "child_weight": 5},
    "depth_4": {"depth": 4, "child_weight": 5},
    "depth_5": {"depth": 5, "child_weight": 5},
    "depth_6": {"depth": 6, "child_weight": 5},
    "depth_3_stronger_child": {"depth": 3, "child_weight": 10},
    "depth_4_stronger_child": {"depth": 4, "child_weight": 10},
}


def early_stopping(
    train: DataFrame, valid: DataFrame, patience: Sequence[int] = (20, 40, 60, 80), rounds: int = 1000, **options
) -> DataFrame:
    """Best number of trees per patience: the last improvement before `patience` rounds pass without one, and the errors with these trees.

    One model is fitted, with the longest patience; its error per round (a short list) answers for the others.
    """
    model = fit_demand_trees(train, valid, rounds=rounds, patience=max(patience), **options)
    best = {}
    for wait in patience:
        best[wait] = 0
        for at, error in enumerate(model.curve):
            if error < model.curve[best[wait]]:
                best[wait] = at
            elif at - best[wait] >= wait:
                break
    facts = valid.sparkSession.createDataFrame(
        [(f"early_stop_{w}", w, at, float(model.curve[at])) for w, at in best.items()],
        "experiment string, early_stopping_rounds int, best_iteration int, best_score double",
    )
    errors = _split_errors({f"early_stop_{w}": (model, at + 1) for w, at in best.items()}, train, valid).withColumnRenamed("model", "experiment")
    return F.broadcast(facts).join(errors, "experiment").orderBy("early_stopping_rounds")
