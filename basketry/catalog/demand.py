"""Daily demand series."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.catalog import TEXTS, query
from basketry.operators.sets import union_all
from basketry.plans import demand as d
from basketry.plans import smoothing

START, TRAIN_END, VALID_END, END = "1996-01-01", "2000-06-30", "2000-12-31", "2001-06-30"
BOUNDS = {"train": (START, TRAIN_END), "validation": ("2000-07-01", VALID_END), "test": ("2001-01-01", END)}
HORIZON = 184

DAILY_BY_STATUS = """
    SELECT s.order_status, u::DATE AS date, count(DISTINCT order_id) AS order_count FROM (
      SELECT order_status, unnest(generate_series(min(order_purchase_timestamp::DATE)::TIMESTAMP, max(order_purchase_timestamp::DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS u
      FROM x_orders GROUP BY 1) s
    LEFT JOIN x_orders o ON o.order_status = s.order_status AND order_purchase_timestamp::DATE = u::DATE GROUP BY 1, 2"""
TRAIN = f"(SELECT * FROM ({DAILY_BY_STATUS}) WHERE date BETWEEN DATE '{START}' AND DATE '{TRAIN_END}')"
FUTURE = f"(SELECT * FROM ({DAILY_BY_STATUS}) WHERE date BETWEEN DATE '2000-07-01' AND DATE '{VALID_END}')"


def _r(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _train(x):
    return d.modelling_window(x.daily_by_status, START, TRAIN_END)


def _valid(x):
    return d.modelling_window(x.daily_by_status, "2000-07-01", VALID_END)


@query("daily_counts", "L1 C12", "SELECT * FROM o_daily")
def daily_counts(x):
    return x.daily


@query("daily_counts_by_status", "L1 C12", DAILY_BY_STATUS)
def daily_counts_by_status(x):
    return x.daily_by_status


PS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


@query("demand_stats", "L2 D6 D7", f"""
    SELECT order_status, count(*) AS days, sum(order_count)::BIGINT AS total_orders, round(avg(order_count), 6) AS mean_orders, median(order_count) AS median_orders,
      round(stddev_samp(order_count), 6) AS std_orders, min(order_count) AS min_orders, max(order_count) AS max_orders, count(*) FILTER (order_count = 0) AS zero_days,
      min(date) FILTER (order_count = 0) AS first_zero_date, max(date) FILTER (order_count = 0) AS last_zero_date,
      {", ".join(f"round(quantile_cont(order_count, {p}), 6) AS {n}" for n, p in PS.items())}, 100.0::DOUBLE * count(*) FILTER (order_count = 0) / count(*) AS zero_days_pct
    FROM ({DAILY_BY_STATUS}) GROUP BY 1""")
def demand_stats(x):
    return _r(d.demand_stats(x.daily_by_status, "order_status"), "mean_orders", "std_orders", *PS)


@query("weekday_profile", "L2 H4", f"""
    SELECT order_status, dayname(date) AS day_of_week, count(*) AS days, round(avg(order_count), 6) AS mean_orders, median(order_count) AS median_orders,
      round(stddev_samp(order_count), 6) AS std_orders FROM ({DAILY_BY_STATUS}) GROUP BY 1, 2""")
def weekday_profile(x):
    return _r(d.weekday_profile(x.daily_by_status, "order_status"), "mean_orders", "std_orders")


@query("monthly_profile", "L2 H4", """
    SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS days, sum(order_count)::BIGINT AS total_orders, round(avg(order_count), 6) AS mean_orders,
      median(order_count) AS median_orders FROM o_daily GROUP BY 1""")
def monthly_profile(x):
    return _r(d.monthly_profile(x.daily), "mean_orders")


@query("extreme_days", "L2 F2", """
    SELECT * FROM (SELECT date, order_count, 'top' AS kind FROM o_daily ORDER BY order_count DESC, date LIMIT 10) UNION ALL
    SELECT * FROM (SELECT date, order_count, 'bottom' AS kind FROM o_daily WHERE order_count > 0 ORDER BY order_count, date LIMIT 10)""")
def extreme_days(x):
    return d.extreme_days(x.daily)


@query("modelling_window", "L3 B10", f"SELECT * FROM o_daily WHERE date BETWEEN DATE '{START}' AND DATE '{END}'")
def modelling_window(x):
    return d.modelling_window(x.daily, START, END)


@query("window_coverage", "L3", f"""
    SELECT CASE WHEN date BETWEEN DATE '{START}' AND DATE '{END}' THEN 'modelling' ELSE 'excluded' END AS part, count(*) AS days, sum(order_count)::BIGINT AS total_orders,
      round(avg(order_count), 6) AS mean_orders, median(order_count) AS median_orders, count(*) FILTER (order_count = 0) AS zero_days FROM o_daily GROUP BY 1""")
def window_coverage(x):
    return _r(d.window_coverage(x.daily, START, END), "mean_orders")


def _roll(w: int) -> str:
    return (
        f"round(avg(order_count) OVER w{w}, 6) AS rolling_mean_{w}, round(stddev_samp(order_count) OVER w{w}, 6) AS rolling_std_{w}, "
        f"min(order_count) OVER w{w} AS rolling_min_{w}, max(order_count) OVER w{w} AS rolling_max_{w}"
    )


@query("demand_features", "L4 E3 E4 E10 H2 H3 B14", f"""
    SELECT * FROM (
      SELECT order_status, date, order_count, (isodow(date) - 1)::INTEGER AS day_of_week, day(date)::INTEGER AS day_of_month, month(date)::INTEGER AS month,
        quarter(date)::INTEGER AS quarter, week(date)::INTEGER AS week_of_year, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
        (row_number() OVER w - 1)::INTEGER AS time_index, {", ".join(f"lag(order_count, {k}) OVER w AS lag_{k}" for k in d.LAGS)}, {", ".join(_roll(w) for w in d.WINDOWS)}
      FROM ({DAILY_BY_STATUS}) WINDOW w AS (PARTITION BY order_status ORDER BY date),
        {", ".join(f"w{w} AS (PARTITION BY order_status ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in d.WINDOWS)})
    WHERE lag_28 IS NOT NULL""")
def demand_features(x):
    df = d.demand_features(x.daily_by_status, "order_status")
    return _r(df, *[f"rolling_{s}_{w}" for s in ("mean", "std") for w in d.WINDOWS])


@query("date_split", "L5", f"""
    SELECT split, min(date) AS first_date, max(date) AS last_date, count(*) AS days, sum(order_count)::BIGINT AS total_orders, round(avg(order_count), 6) AS mean_orders FROM (
      SELECT *, CASE {" ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{s}'" for s, (a, b) in BOUNDS.items())} END AS split FROM o_daily)
    WHERE split IS NOT NULL GROUP BY 1""")
def date_split(x):
    return _r(d.date_split_summary(d.date_split(x.daily, BOUNDS)), "mean_orders")


BASE = f"""
    SELECT order_status, date, order_count, lag(order_count, 1) OVER w::DOUBLE AS naive, lag(order_count, 7) OVER w::DOUBLE AS seasonal_naive_7,
      CASE WHEN count(order_count) OVER w7 = 7 THEN avg(order_count) OVER w7 END AS moving_average_7 FROM ({DAILY_BY_STATUS})
    WINDOW w AS (PARTITION BY order_status ORDER BY date), w7 AS (PARTITION BY order_status ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


@query("baselines", "L6", f"SELECT * EXCLUDE (moving_average_7), round(moving_average_7, 6) AS moving_average_7 FROM ({BASE})")
def baselines(x):
    return _r(d.baselines(x.daily_by_status, "order_status"), "moving_average_7")


ENDS = f"""SELECT order_status, arg_min(order_count, date)::DOUBLE AS y1, arg_max(order_count, date)::DOUBLE AS yn, count(*) AS n, max(date) AS last_date,
    coalesce((arg_max(order_count, date)::DOUBLE - arg_min(order_count, date)) / nullif(count(*) - 1, 0), 0) AS slope FROM {TRAIN} GROUP BY 1"""
STEPS = f"(SELECT unnest(generate_series(1, {HORIZON}))::INTEGER AS step)"


@query("drift", "L7", f"""
    SELECT order_status, 'drift' AS model, step, last_date + step AS date, round(greatest(0, yn + step * slope), 6) AS prediction FROM ({ENDS}) CROSS JOIN {STEPS}""")
def drift(x):
    return _r(d.drift(_train(x), HORIZON, "order_status"), "prediction")


@query("damped_drift", "L8", f"""
    SELECT order_status, 'damped_drift_' || phi::VARCHAR AS model, step, last_date + step AS date, round(greatest(0, yn + slope * (1 - pow(phi, step)) / (1 - phi)), 6) AS prediction
    FROM ({ENDS}) CROSS JOIN {STEPS} CROSS JOIN (SELECT unnest([0.7, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS phi)""")
def damped_drift(x):
    return _r(d.damped_drift(_train(x), HORIZON, by="order_status"), "prediction")


# The reference form is a recursion: every prediction feeds the season after it.
@query("seasonal_drift", "L9", f"""
    WITH RECURSIVE t AS (SELECT order_status, date, order_count::DOUBLE AS y, date_diff('day', date, max(date) OVER (PARTITION BY order_status)) AS age,
      max(date) OVER (PARTITION BY order_status) AS last_date FROM {TRAIN}),
    sig AS (SELECT order_status, avg(y) FILTER (age < 7) - avg(y) FILTER (age BETWEEN 7 AND 13) AS trend FROM t GROUP BY 1),
    f AS (
      SELECT t.order_status, w, (7 - age)::INTEGER AS step, last_date, greatest(0, y + w * trend) AS prediction, trend FROM t JOIN sig USING (order_status)
      CROSS JOIN (SELECT unnest([0.1, 0.25, 0.5, 0.75])::DOUBLE AS w) WHERE age < 7
      UNION ALL SELECT order_status, w, step + 7, last_date, greatest(0, prediction + w * trend), trend FROM f WHERE step + 7 <= {HORIZON})
    SELECT order_status, 'seasonal_naive_drift_' || w::VARCHAR AS model, step, last_date + step AS date, round(prediction, 6) AS prediction FROM f""")
def seasonal_drift(x):
    return _r(d.seasonal_drift(_train(x), HORIZON, by="order_status"), "prediction")


@query("weekday_adjusted", "L10", f"""
    SELECT f.order_status, 'weekday_adjusted_naive' AS model, f.date, round(greatest(0, yn * coalesce(m.avg_day / o.avg_all, 1)), 6) AS prediction
    FROM {FUTURE} f JOIN ({ENDS}) e USING (order_status) JOIN (SELECT order_status, avg(order_count) AS avg_all FROM {TRAIN} GROUP BY 1) o USING (order_status)
    LEFT JOIN (SELECT order_status, isodow(date) AS k, avg(order_count) AS avg_day FROM {TRAIN} GROUP BY 1, 2) m ON m.order_status = f.order_status AND m.k = isodow(f.date)""")
def weekday_adjusted(x):
    return _r(d.weekday_adjusted(_train(x), _valid(x), "order_status"), "prediction")


@query("exponential_smoothing", "L11")
def exponential_smoothing(x):
    fits = x.stored(smoothing.smoothing_fits(_train(x), "order_count", d.SMOOTHING, "order_status"), "smoothing-fits")
    df = smoothing.smoothing_forecasts(fits, HORIZON)
    actual = _valid(x).select("order_status", "date", F.col("order_count").cast("double").alias("actual"))
    return d.forecast_errors(df.join(actual, ["order_status", "date"]), ["order_status", "model"])


SPLIT_BASE = f"""(SELECT *, CASE {" ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{s}'" for s, (a, b) in BOUNDS.items())} END AS split FROM ({BASE}))"""
LONG = " UNION ALL ".join(f"SELECT order_status, split, '{m}' AS model, order_count::DOUBLE AS actual, {m} AS prediction FROM {SPLIT_BASE} WHERE split IS NOT NULL" for m in d.BASELINES)
ERRORS = f"""SELECT split, model, avg(abs(actual - prediction)) AS mae, sqrt(avg(pow(actual - prediction, 2))) AS rmse, count(*) AS evaluation_days FROM ({LONG})
    WHERE prediction IS NOT NULL GROUP BY 1, 2"""


def _errors(x):
    wide = d.date_split(d.baselines(x.daily_by_status, "order_status"), BOUNDS)
    return d.forecast_errors(d.predictions_long(wide, d.BASELINES, ["order_status", "date", "split"]), ["split", "model"])


@query("forecast_errors", "L12", f"SELECT split, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, evaluation_days FROM ({ERRORS})")
def forecast_errors(x):
    return _r(_errors(x), "mae", "rmse")


def _analysis(key: str) -> str:
    names = {"naive": "naive", "seasonal_naive": "seasonal_naive_7", "moving_average": "moving_average_7"}
    parts = [f"round(avg(abs(order_count - {c})), 6) AS {n}_mae, round(avg(order_count - {c}), 6) AS {n}_bias" for n, c in names.items()]
    return f"""SELECT {key}, count(date) AS days, round(avg(order_count), 6) AS actual_mean, {", ".join(parts)} FROM {SPLIT_BASE} WHERE split IN ('validation', 'test') GROUP BY 1"""


def _by(x, key):
    wide = d.date_split(d.baselines(x.daily_by_status, "order_status"), BOUNDS).filter("split <> 'train'")
    df = d.error_analysis(d.with_errors(wide), key)
    return _r(df, *[c for c in df.columns if c.endswith(("_mae", "_bias", "_mean"))])


@query("errors_by_month", "L13", _analysis("strftime(date, '%Y-%m') AS month"))
def errors_by_month(x):
    return _by(x, "month")


@query("errors_by_weekday", "L13", _analysis("dayname(date) AS weekday"))
def errors_by_weekday(x):
    return _by(x, "weekday")


@query("champion_table", "L14", f"""
    SELECT e.split, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, evaluation_days, round(100.0 * (mae - n) / n, 4) AS mae_vs_reference_pct
    FROM ({ERRORS}) e JOIN (SELECT split, mae AS n FROM ({ERRORS}) WHERE model = 'naive') b USING (split)""")
def champion_table(x):
    return _r(_r(d.champion_table(_errors(x), by="split"), "mae", "rmse"), "mae_vs_reference_pct", digits=4)


def _trend_models(x):
    """Forecasts of all closed-form models for the validation days."""
    days = _train(x)
    parts = [
        d.drift(days, HORIZON, "order_status"), d.damped_drift(days, HORIZON, by="order_status"), d.seasonal_drift(days, HORIZON, by="order_status"),
        d.weekday_adjusted(days, _valid(x), "order_status"),
    ]
    return union_all(*[p.select("order_status", "model", "date", "prediction") for p in parts])


def _trend_errors(x, forecasts):
    actual = _valid(x).select("order_status", "date", F.col("order_count").cast("double").alias("actual"))
    return d.forecast_errors(forecasts.join(actual, ["order_status", "date"]), ["order_status", "model"])


TREND_TEXT = " UNION ALL ".join(f"SELECT order_status, model, date, prediction FROM ({TEXTS[name]})" for name in ("drift", "damped_drift", "seasonal_drift", "weekday_adjusted"))
TREND_ERRORS = f"""SELECT p.order_status, p.model, avg(abs(order_count - prediction)) AS mae, sqrt(avg(pow(order_count - prediction, 2))) AS rmse, count(*) AS evaluation_days
    FROM ({TREND_TEXT}) p JOIN {FUTURE} f ON f.order_status = p.order_status AND f.date = p.date GROUP BY 1, 2"""


@query("trend_champions", "L7 L8 L9 L10 L14", f"""
    WITH e AS ({TREND_ERRORS})
    SELECT e.order_status, model, round(mae, 4) AS mae, round(rmse, 4) AS rmse, evaluation_days, round(100.0 * (mae - base) / nullif(base, 0), 2) AS mae_vs_reference_pct
    FROM e LEFT JOIN (SELECT order_status, mae AS base FROM e WHERE model = 'drift') b ON b.order_status = e.order_status""")
def trend_champions(x):
    table = d.champion_table(_trend_errors(x, _trend_models(x)), "drift", "order_status")
    return _r(_r(table, "mae", "rmse", digits=4), "mae_vs_reference_pct", digits=2)


@query("forecast_champions", "L11 L14")
def forecast_champions(x):
    """Trend models and smoothing in one table, by their error on the validation days."""
    fits = x.stored(smoothing.smoothing_fits(_train(x), "order_count", d.SMOOTHING, "order_status"), "smoothing-fits")
    smooth = smoothing.smoothing_forecasts(fits, HORIZON).select("order_status", "model", "date", "prediction")
    return d.champion_table(_trend_errors(x, _trend_models(x).unionByName(smooth)), "drift", "order_status")


def _feature_splits(x):
    df = x.stored(d.date_split(d.demand_features(x.daily_by_status, "order_status"), BOUNDS), "demand-features")
    return df.filter("split = 'train'"), df.filter("split = 'validation'"), df.filter("split = 'test'")


@query("demand_trees", "L15")
def demand_trees(x):
    train, valid, _ = _feature_splits(x)
    model = d.fit_demand_trees(train)
    scored = d.predict_demand(model, valid).withColumn("actual", F.col("order_count").cast("double"))
    errors = d.forecast_errors(scored, "order_status").select(F.col("order_status").alias("entry"), F.col("mae").alias("value"))
    return errors.unionByName(d.importances(model, valid).select(F.col("feature").alias("entry"), F.col("importance").alias("value")))


@query("demand_sweep", "L16")
def demand_sweep(x):
    train, valid, _ = _feature_splits(x)
    grid = {name: {"features": cols} for name, cols in d.FEATURE_SETS.items()}
    return d.sweep(grid | d.PARAMETER_GRID, train, valid)


@query("demand_early_stopping", "L16")
def demand_early_stopping(x):
    train, valid, _ = _feature_splits(x)
    return d.early_stopping(train, valid)


@query("demand_final", "L14 L16")
def demand_final(x):
    """Refit on train and validation, compare with the baselines on the test days."""
    train, valid, test = _feature_splits(x)
    model = d.fit_demand_trees(train.unionByName(valid), rounds=131)
    trees = d.predict_demand(model, test).select("order_status", "date", F.lit("boosted_trees").alias("model"), F.col("order_count").cast("double").alias("actual"), "prediction")
    base = d.predictions_long(d.baselines(x.daily_by_status, "order_status"), d.BASELINES, ["order_status", "date"])
    days = test.select("order_status", "date")
    both = trees.unionByName(base.join(days, ["order_status", "date"]))
    return d.champion_table(d.forecast_errors(both, "model"))
