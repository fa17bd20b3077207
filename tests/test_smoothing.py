import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.plans import demand, smoothing

START = dt.date(2020, 1, 1)


def series(kind, n=84):
    draw = random.Random(kind)
    season = [0, 1, 2, 5, 9, 12, 3]
    if kind == "weekly":
        return [30 + 0.2 * i + season[i % 7] + draw.gauss(0, 1) for i in range(n)]
    if kind == "flat":
        return [5.0] * n
    if kind == "walk":
        level, out = 50.0, []
        for _ in range(n):
            level += draw.gauss(0, 2)
            out.append(max(0.0, level))
        return out
    return [draw.choice([0.0, 3.0]) for _ in range(n)]


KINDS = ("weekly", "flat", "walk", "noise")


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, START + dt.timedelta(days=i), v) for k in KINDS for i, v in enumerate(series(k))] + [("short", START, 1.0)]
    return spark.createDataFrame(rows, "series string, date date, order_count double").repartition(3).cache()


@pytest.fixture(scope="module")
def fits(table):
    return smoothing.smoothing_fits(table, "order_count", demand.SMOOTHING, "series").cache()


#: The model written as a recursive query: one step a row, season as a list of the last seven values.
RECURSION = """
    WITH RECURSIVE days AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY date) AS t, order_count AS y FROM demand),
    run AS (
      SELECT series, model, alpha, beta, gamma, phi, seasonal, trend, 0 AS t, level0 AS l, slope0 AS b, season0 AS s, 0.0::DOUBLE AS sse FROM fits
      UNION ALL
      SELECT series, model, alpha, beta, gamma, phi, seasonal, trend, t, nl, CASE WHEN trend THEN beta * (nl - l) + (1 - beta) * phi * b ELSE 0 END,
        list_concat(s[2:], [CASE WHEN seasonal THEN gamma * (y - nl) + (1 - gamma) * s[1] ELSE 0 END]), sse + (y - l - phi * b - s[1]) ** 2
      FROM (SELECT run.* EXCLUDE (t), d.t, d.y, alpha * (d.y - s[1]) + (1 - alpha) * (l + phi * b) AS nl FROM run JOIN days AS d ON d.series = run.series AND d.t = run.t + 1)
    ),
    last AS (SELECT * FROM run WHERE t = 84)
    SELECT series, model, sse, k AS step, greatest(0, l + b * list_sum(list_transform(range(1, k + 1), lambda i: phi ** i)) + s[(k - 1) % 7 + 1]) AS prediction
    FROM last, (SELECT unnest(range(1, 11)) AS k)"""


def test_error_and_forecast_by_a_recursive_query(table, fits):
    config = fits.toPandas()
    config["trend"] = [demand.SMOOTHING[m][0] for m in config["model"]]
    config["seasonal"] = [demand.SMOOTHING[m][1] for m in config["model"]]
    con = duckdb.connect()
    con.register("demand", table.filter("series <> 'short'").toPandas())
    con.register("fits", config.drop(columns="last_date"))
    want = {(s, m, k): (sse, p) for s, m, sse, k, p in con.execute(RECURSION).fetchall()}
    got = {(r["series"], r["model"], r["step"]): (r["sse"], r["prediction"]) for r in smoothing.smoothing_forecasts(fits, 10).collect()}
    assert set(got) == set(want) and len(got) == len(KINDS) * len(demand.SMOOTHING) * 10
    for key, (sse, value) in want.items():
        assert got[key][0] == pytest.approx(sse, rel=1e-6, abs=1e-6)
        assert got[key][1] == pytest.approx(value, rel=1e-6, abs=1e-6)


def test_never_worse_than_the_grid(table, fits):
    grid = demand.smoothing_backtest(table, 1, by="series").select("series", "model", F.col("sse").alias("grid"))
    both = grid.join(fits, ["series", "model"]).collect()
    assert len(both) == len(KINDS) * len(demand.SMOOTHING)
    for r in both:
        assert r["sse"] <= r["grid"] + 1e-9
    assert any(r["sse"] < 0.8 * r["grid"] for r in both)


def test_bounds_and_nesting(fits):
    rows = {(r["series"], r["model"]): r for r in fits.collect()}
    for r in rows.values():
        assert all(0 <= r[c] <= 1 for c in ("alpha", "beta", "gamma"))
        assert r["phi"] == 1.0 or 0.8 <= r["phi"] <= 0.995
    for k in KINDS:  # the richer model contains the poorer one
        assert rows[k, "additive_trend_seasonal"]["sse"] <= rows[k, "seasonal_only"]["sse"] * 1.01 + 1e-6
        assert rows[k, "additive_trend_seasonal"]["sse"] <= rows[k, "trend_only"]["sse"] * 1.01 + 1e-6
    assert rows["flat", "trend_only"]["sse"] == pytest.approx(0, abs=1e-9)


def test_starting_states_are_the_best_for_their_parameters():
    y, rng = np.array(series("weekly")), np.random.default_rng(1)
    points = np.array([[0.3, 0.1, 0.2, 0.9]])
    errors, _ = smoothing.one_step_errors(y, points, True, True, 7)
    starts, sse = smoothing.best_starts(errors)
    for _ in range(50):
        other = errors[:, 0] @ np.concatenate(([1.0], starts[0] + rng.normal(0, 0.5, len(starts[0]))))
        assert (other**2).sum() >= sse[0] - 1e-9


def test_simplex_finds_a_bounded_minimum():
    low, high = np.zeros(2), np.ones(2)
    loss = lambda p: (p[:, 0] - 0.3) ** 2 + 10 * (p[:, 1] - 1.7) ** 2 + p[:, 0] * 0.1
    point, value = smoothing.simplex_search(loss, np.array([[0.9, 0.1], [0.1, 0.2]]), low, high)
    assert point == pytest.approx([0.25, 1.0], abs=1e-3) and value == pytest.approx(loss(point[None])[0])


def test_no_series(table):
    assert smoothing.smoothing_fits(table.limit(0), "order_count", demand.SMOOTHING, "series").count() == 0
    one = smoothing.smoothing_fits(table.filter("series = 'walk'"), "order_count", {"trend_only": (True, False, False)}).collect()
    assert len(one) == 1 and one[0]["days"] == 84
