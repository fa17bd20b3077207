"""Exponential smoothing fitted by search: parameters by a bounded simplex, starting states by least squares.

With additive trend and season every one-step error is linear in the starting level, slope and season. So a point of the search has
only the smoothing parameters; its best starting states solve a least-squares problem, and the search sees the remaining squared error.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from basketry.operators.ordering import as_list

# Bounds of level, trend, season and damping parameter.
BOUNDS = ((0.0, 1.0), (0.0, 1.0), (0.0, 1.0), (0.8, 0.995))
GRID = (0.02, 0.1, 0.25, 0.5, 0.8)
DAMPING = (0.85, 0.95, 0.99)


def one_step_errors(y: np.ndarray, points: np.ndarray, trend: bool, seasonal: bool, period: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Errors of every point (alpha, beta, gamma, phi) as affine functions of the starting states, and the final states likewise.

    The last axis holds the constant, then the coefficients of the starting level, slope (with `trend`) and season (with `seasonal`).
    """
    k, width = len(points), 2 + trend + period * seasonal
    alpha, beta, gamma, phi = (points[:, i, None] for i in range(4))
    level, slope, season = np.zeros((k, width)), np.zeros((k, width)), np.zeros((period, k, width))
    level[:, 1] = 1
    if trend:
        slope[:, 2] = 1
    if seasonal:
        for j in range(period):
            season[j, :, 2 + trend + j] = 1
    errors = np.empty((len(y), k, width))
    for t, value in enumerate(y):
        at = t % period
        drifted = level + phi * slope if trend else level
        error = -(drifted + season[at])
        error[:, 0] += value
        errors[t] = error
        before = level
        # y - season = error + drifted, so the new level is the drifted one moved by alpha times the error
        level = drifted + alpha * error
        if trend:
            slope = beta * (level - before) + (1 - beta) * phi * slope
        if seasonal:
            rest = -level
            rest[:, 0] += value
            season[at] = gamma * rest + (1 - gamma) * season[at]
    return errors, [level, slope, season]


def best_starts(errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starting states of least squared error for every point, and that error."""
    fixed, by_state = errors[:, :, 0].T, errors[:, :, 1:].transpose(1, 0, 2)
    inner = by_state.transpose(0, 2, 1) @ by_state
    right = (by_state.transpose(0, 2, 1) @ fixed[:, :, None])[:, :, 0]
    starts = -(np.linalg.pinv(inner, rcond=1e-11, hermitian=True) @ right[:, :, None])[:, :, 0]
    left = fixed + (by_state @ starts[:, :, None])[:, :, 0]
    return starts, (left * left).sum(1)


def _simplex(start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, tolerance: float) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, float]]:
    """One search inside a box: yields points, is sent their losses, returns the best corner. Never worse than `start`."""
    n = len(start)
    corners = np.repeat(start[None], n + 1, 0)
    for i in range(n):
        width = 0.15 * (high[i] - low[i])
        corners[i + 1, i] += width if start[i] + width <= high[i] else -width
    values = yield corners
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        corners, values = corners[order], values[order]
        if values[-1] - values[0] <= tolerance * (1 + abs(values[0])) and np.ptp(corners, axis=0).max() < 1e-3:
            break
        middle = corners[:-1].mean(0)
        tries = np.clip(middle + np.array([[1.0], [2.0], [0.5], [-0.5]]) * (middle - corners[-1]), low, high)
        reflected, expanded, outside, inside = found = yield tries
        if reflected < values[0]:
            pick = 1 if expanded < reflected else 0
        elif reflected < values[-2]:
            pick = 0
        elif reflected < values[-1]:
            pick = 2 if outside <= reflected else -1
        else:
            pick = 3 if inside < values[-1] else -1
        if pick >= 0:
            corners[-1], values[-1] = tries[pick], found[pick]
        else:
            corners[1:] = corners[0] + 0.5 * (corners[1:] - corners[0])
            values[1:] = yield corners[1:]
    best = int(np.argmin(values))
    return corners[best], float(values[best])


def simplex_search(
    loss: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 150, tolerance: float = 1e-7
) -> tuple[np.ndarray, float]:
    """The best end of Nelder-Mead searches from several points, which share each evaluation of `loss` on many points."""
    searches = [_simplex(x.astype(float), low, high, steps, tolerance) for x in starts]
    asked = [(s, next(s)) for s in searches]
    ends = []
    while asked:
        found = np.split(loss(np.concatenate([p for _, p in asked])), np.cumsum([len(p) for _, p in asked])[:-1])
        following = []
        for (search, _), values in zip(asked, found, strict=True):
            try:
                following.append((search, search.send(values.copy())))
            except StopIteration as end:
                ends.append(end.value)
        asked = following
    return min(ends, key=lambda r: r[1])


def fitted(y: np.ndarray, trend: bool, seasonal: bool, damped: bool, period: int, starts: int = 3) -> dict:
    """Parameters, starting and final states and squared error of one series: the best of searches from the best points of a grid."""
    free = [0, *([1] if trend else []), *([2] if seasonal else []), *([3] if damped else [])]
    axes = [DAMPING if i == 3 else GRID for i in free]
    low, high = (np.array([BOUNDS[i][side] for i in free]) for side in (0, 1))

    def whole(points: np.ndarray) -> np.ndarray:
        out = np.tile([0.0, 0.0, 0.0, 1.0], (len(points), 1))
        out[:, free] = points
        return out

    def loss(points: np.ndarray) -> np.ndarray:
        return best_starts(one_step_errors(y, whole(points), trend, seasonal, period)[0])[1]

    grid = np.stack([x.ravel() for x in np.meshgrid(*axes, indexing="ij")], 1)
    values = np.concatenate([loss(grid[i : i + 32]) for i in range(0, len(grid), 32)])
    point, _ = simplex_search(loss, grid[np.argsort(values, kind="stable")[:starts]], low, high)
    # a second, fresh simplex around the best end, as a first one can collapse early
    point, _ = simplex_search(loss, point[None], low, high)
    params = whole(point[None])
    errors, states = one_step_errors(y, params, trend, seasonal, period)
    first, sse = best_starts(errors)
    at = np.concatenate(([1.0], first[0]))
    level, slope, season = states[0][0] @ at, states[1][0] @ at, states[2][:, 0] @ at
    return {
        **dict(zip(("alpha", "beta", "gamma", "phi"), params[0].tolist(), strict=True)), "sse": float(sse[0]), "level0": float(first[0][0]),
        "slope0": float(first[0][1]) if trend else 0.0, "season0": (first[0][1 + trend :] if seasonal else np.zeros(period)).tolist(),
        "level": float(level), "slope": float(slope), "season": season.tolist(), "days": len(y),
    }


_DOUBLES = ("alpha", "beta", "gamma", "phi", "sse", "level0", "slope0", "level", "slope")
_SEASONS = ("season0", "season")


def smoothing_fits(
    train: DataFrame, value: str, configs: Mapping[str, tuple[bool, bool, bool]], by: str | Sequence[str] = (), period: int = 7, time: str = "date"
) -> DataFrame:
    """One row per series and configuration (trend, seasonal, damped): parameters, starting states, squared error and final states.

    A series is one array, bounded by its days, and each (series, configuration) is fitted by itself, spread over tasks. Series of fewer than two
    periods are left out.
    """
    by = as_list(by)
    series = train.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(time, F.col(value).cast("double").alias("y")))).alias("__s"), F.max(time).alias("last_date")
    ).select(*by, "last_date", F.transform("__s", lambda s: s["y"]).alias("__y")).filter(F.size("__y") >= 2 * period)
    names = F.explode(F.array(*[F.lit(c) for c in configs])).alias("model")
    runs = series.select(*by, "last_date", names, "__y")
    # one row is seconds of work, so rows are dealt out one by one, not by size
    runs = runs.repartition(max(runs.sparkSession.sparkContext.defaultParallelism, 1), *by, "model")
    kept = [*by, "last_date", "model"]
    schema = StructType([
        *(runs.schema[c] for c in [*by, "last_date"]), StructField("model", StringType()), *(StructField(c, DoubleType()) for c in _DOUBLES),
        *(StructField(c, ArrayType(DoubleType())) for c in _SEASONS), StructField("days", LongType()),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for name, y in zip(part.column("model").to_pylist(), part.column("__y").to_pylist(), strict=True):
                rows.append(fitted(np.array(y, float), *configs[name], period))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in kept), *(pa.array([r[c] for r in rows], pa.float64()) for c in _DOUBLES),
                        *(pa.array([r[c] for r in rows], pa.list_(pa.float64())) for c in _SEASONS), pa.array([r["days"] for r in rows], pa.int64()),
                    ],
                    [*kept, *_DOUBLES, *_SEASONS, "days"],
                )

    return runs.mapInArrow(run, schema)


def smoothing_forecasts(fits: DataFrame, horizon: int) -> DataFrame:
    """Forecasts of every fitted row, 1 to `horizon` days ahead, floored at zero."""
    ahead = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    reach = F.when(F.col("phi") == 1.0, F.col("step").cast("double")).otherwise(
        F.col("phi") * (F.lit(1.0) - F.pow("phi", "step")) / (F.lit(1.0) - F.col("phi"))
    )
    place = ((F.col("days") + F.col("step") - 1) % F.size("season")).cast("int")
    value = F.col("level") + reach * F.col("slope") + F.get("season", place)
    return ahead.withColumns({"date": F.date_add("last_date", F.col("step")), "prediction": F.greatest(value, F.lit(0.0))}).drop(
        "level0", "slope0", "season0", "level", "slope", "season", "days", "last_date"
    )
