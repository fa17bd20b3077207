import datetime as dt

import pytest

from basketry.plans import demand as d

START = dt.date(2020, 1, 1)


def series(spark, values, name="s"):
    rows = [(name, START + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, date date, order_count int")


def smooth(y, alpha, beta, gamma, phi, trend, seasonal, horizon, m=7):
    level = sum(y[:m]) / m
    slope = (sum(y[m : 2 * m]) / m - level) / m if trend else 0.0
    season = [(v - level) if seasonal else 0.0 for v in y[:m]]
    sse = 0.0
    for i, v in enumerate(y):
        s, drifted = season[i % m], level + phi * slope
        sse += (v - drifted - s) ** 2
        new = alpha * (v - s) + (1 - alpha) * drifted
        slope = beta * (new - level) + (1 - beta) * phi * slope if trend else 0.0
        if seasonal:
            season[i % m] = gamma * (v - new) + (1 - gamma) * s
        level = new
    out = []
    for h in range(1, horizon + 1):
        reach = sum(phi**k for k in range(1, h + 1))
        out.append(max(0.0, level + reach * slope + season[(len(y) + h - 1) % m]))
    return sse, out


VALUES = [10, 12, 9, 14, 20, 25, 8, 11, 13, 10, 15, 22, 27, 9, 12, 15, 11, 17, 23, 30, 10, 13, 14]


@pytest.mark.parametrize("name", list(d.SMOOTHING))
def test_smoothing_picks_the_best_grid_point(spark, name):
    trend, seasonal, damped = d.SMOOTHING[name]
    grid, phis = (0.1, 0.5), (0.9,)
    tries = [
        smooth(VALUES, a, b, g, p, trend, seasonal, 10)
        for a in grid for b in (grid if trend else [0.0]) for g in (grid if seasonal else [0.0]) for p in (phis if damped else [1.0])
    ]
    want = min(tries, key=lambda t: t[0])
    out = d.smoothing_backtest(series(spark, VALUES), 10, {name: d.SMOOTHING[name]}, "series", grid, phis).orderBy("step").collect()
    assert out[0].sse == pytest.approx(want[0])
    assert [r.prediction for r in out] == pytest.approx(want[1])
    assert out[0].date == START + dt.timedelta(days=len(VALUES))


def test_short_series(spark):
    one = d.drift(series(spark, [4]), 3, "series").orderBy("step").collect()
    assert [r.prediction for r in one] == [4.0] * 3
    few = d.seasonal_drift(series(spark, [4, 6]), 2, (0.5,), "series").orderBy("step").collect()
    assert [r.prediction for r in few] == [6.0] * 2


def test_falling_series_stop_at_zero(spark):
    out = d.drift(series(spark, [9, 6, 3]), 3, "series").orderBy("step").collect()
    assert [r.prediction for r in out] == [0.0, 0.0, 0.0]


def test_series_do_not_mix(spark):
    both = series(spark, range(1, 41), "a").unionByName(series(spark, range(101, 141), "b"))
    out = d.demand_features(both, "series")
    assert out.count() == 24
    assert out.filter("lag_1 <> order_count - 1 or rolling_mean_7 <> order_count - 4").count() == 0
    assert {r.time_index for r in out.filter("series = 'b'").collect()} == set(range(28, 40))


def test_errors_skip_missing_predictions(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, None), ("m", 5.0, 1.0)], "model string, actual double, prediction double")
    row = d.forecast_errors(df, "model").first()
    assert (row.mae, row.evaluation_days) == (2.5, 2) and row.rmse == pytest.approx((17 / 2) ** 0.5)
