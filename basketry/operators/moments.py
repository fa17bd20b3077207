"""Means, deviations and co-moments of many columns in one pass over Arrow batches.

An aggregate of several hundred buffers is too long for the JVM to compile; here a task multiplies matrices of a batch, and one small row per
pair of columns and task is left to add up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELLS = ["n", "mean_a", "mean_b", "aa", "bb", "ab"]
_SCHEMA = "a int, b int, n double, mean_a double, mean_b double, aa double, bb double, ab double"


def columns_of(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Double columns, one in a row of the result, as they lie in memory; null becomes NaN."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float, copy=False)


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together; the cells lie on the first axis."""
    n1, a1, b1, *_ = left
    n2, a2, b2, *_ = right
    n = n1 + n2
    share = np.divide(n2, n, out=np.zeros_like(n), where=n > 0)
    da, db = np.where(n2 > 0, a2 - a1, 0.0), np.where(n2 > 0, b2 - b1, 0.0)
    both = n1 * share
    return np.stack([
        n, a1 + da * share, b1 + db * share, left[3] + right[3] + da * da * both, left[4] + right[4] + db * db * both, left[5] + right[5] + da * db * both,
    ])


def of_batch(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Cells of all pairs of columns, each pair over the rows that know both. A column is a row of `x`."""
    # moved by a value of the column itself, so that a constant column's deviations are exactly 0
    shift = x[np.arange(len(x)), known.argmax(1)]
    shift = np.where(known.any(1) & np.isfinite(shift), shift, 0.0)
    z = x - shift[:, None]
    whole = known.all()
    if not whole:
        z[~known] = 0.0
    if whole:
        n, sab = np.full((len(x), len(x)), float(x.shape[1])), z @ z.T
        sa, saa = (np.repeat(v[:, None], len(x), 1) for v in (z.sum(1), np.diag(sab)))
    else:
        m = known.astype(float)
        n, sa, saa, sab = m @ m.T, z @ m.T, (z * z) @ m.T, z @ z.T
    some = np.maximum(n, 1.0)
    aa = saa - sa * sa / some
    return np.stack([n, sa / some + shift[:, None], sa.T / some + shift[None, :], aa, aa.T, sab - sa * sa.T / some])


def co_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per pair of columns (by place, a <= b): rows that know both, their means, sums of squared deviations and of their products."""
    cols, names = list(cols), [f"c{k}" for k in range(len(cols))]
    rows, places = np.triu_indices(len(cols))

    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            if not part.num_rows:
                continue
            known = np.stack([part.column(c).is_valid().to_numpy(zero_copy_only=False) for c in names])
            with np.errstate(invalid="ignore", over="ignore"):
                found = of_batch(columns_of(part, names), known)
                total = found if total is None else merged(total, found)
        if total is not None:
            cells = [pa.array(c[rows, places]) for c in total]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(places, pa.int32()), *cells], ["a", "b", *_CELLS])

    def together(part: pd.DataFrame) -> pd.DataFrame:
        cells = part[_CELLS].to_numpy(float)
        order = np.lexsort(cells.T)
        total = cells[order[0]]
        with np.errstate(invalid="ignore", over="ignore"):
            for k in order[1:]:
                total = merged(total, cells[k])
        return pd.DataFrame([[int(part["a"].iloc[0]), int(part["b"].iloc[0]), *total]], columns=["a", "b", *_CELLS])

    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names, strict=True)])
    return doubles.mapInArrow(local, _SCHEMA).groupBy("a", "b").applyInPandas(together, _SCHEMA)
