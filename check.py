"""Run the registered queries against their DuckDB texts: `python check.py [folder] [name ...]`.

`--compared` leaves out the queries that have no text.
"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

from basketry import catalog
from basketry.catalog.fixtures import BASE_TABLES
from basketry.session import build_session


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


KINDS = {
    "int": ("tinyint", "smallint", "int", "integer", "bigint", "hugeint", "ubigint"),
    "real": ("float", "double", "real"),
    "text": ("string", "varchar"),
    "stamp": ("timestamp", "timestamp_ntz"),
    "date": ("date",),
    "flag": ("boolean",),
}


def kind(name: str) -> str:
    """The same word for matching types of both engines."""
    return next((k for k, names in KINDS.items() if name.lower() in names), name.lower())


def kinds_differ(frame, con, sql: str) -> str | None:
    """Columns whose type differs in kind, such as an integer against a double."""
    spark_side = {c: kind(t) for c, t in frame.dtypes}
    duck_side = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = {c: (k, duck_side.get(c)) for c, k in spark_side.items() if duck_side.get(c) not in (k, '"null"')}
    return f"types {odd}" if odd else None


def canonical(pdf: pd.DataFrame, digits: int = 9) -> pd.DataFrame:
    """Columns by name, rows in value order, values in one spelling."""
    out = pd.DataFrame(index=pdf.index)
    for c in sorted(pdf.columns):
        v = pdf[c]
        if pd.api.types.is_bool_dtype(v):
            out[c] = v.astype(str)
        elif pd.api.types.is_float_dtype(v) or pd.api.types.is_integer_dtype(v):
            f = v.astype("float64")
            out[c] = [("null" if np.isnan(a) else f"{a + 0.0:.{digits}g}") for a in f]
        elif pd.api.types.is_datetime64_any_dtype(v):
            out[c] = v.astype(str).str.replace(" 00:00:00", "", regex=False)
        else:
            out[c] = ["null" if a is None or a is pd.NaT or (isinstance(a, float) and np.isnan(a)) else str(a) for a in v]
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark_rows: pd.DataFrame, duck_rows: pd.DataFrame) -> str | None:
    """None if both hold the same rows, else what differs."""
    if sorted(spark_rows.columns) != sorted(duck_rows.columns):
        return f"columns {sorted(set(spark_rows.columns) ^ set(duck_rows.columns))}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}"
    a, b = canonical(spark_rows), canonical(duck_rows)
    for c in a.columns:
        differs = (a[c] != b[c]).to_numpy()
        if differs.any():
            at = int(differs.argmax())
            return f"column {c}, {int(differs.sum())} rows, e.g. {a[c].iloc[at]!r} vs {b[c].iloc[at]!r}"
    return None


def run(spark, con, folder: str, name: str) -> tuple[str | None, int, float]:
    """(problem, rows, seconds of the Spark side)."""
    began = time.time()
    frame = catalog.QUERIES[name](spark, folder)
    rows = frame.toPandas()
    seconds = time.time() - began
    if name not in catalog.ORACLES:
        return (None if len(rows) else "no rows"), len(rows), seconds
    expected = con.execute(catalog.ORACLES[name]).df()
    return compare(rows, expected) or kinds_differ(frame, con, catalog.ORACLES[name]), len(rows), seconds


def main(argv: list[str]) -> int:
    compared = "--compared" in argv
    argv = [a for a in argv if a != "--compared"]
    folder = argv[0] if argv else "/root/testdata/sf0.001"
    catalog.load()
    names = [n for n in catalog.QUERIES if not argv[1:] or any(n.startswith(w) for w in argv[1:])]
    if compared:
        names = [n for n in names if n in catalog.ORACLES]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        try:
            problem, rows, seconds = run(spark, con, folder, name)
        except Exception as e:  # a failing query must not hide the others
            problem, rows, seconds = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if name in catalog.ORACLES else "rows")
        print(f"{mark:5} {name:36} {rows:8} {seconds:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
