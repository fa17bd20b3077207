"""Projections, labels, literals and row identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.ordering import number_rows

# Fixed column lists of the staging layer.
STAGED_COLUMNS = {
    "customers": [
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state",
    ],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date"],
    "products": [
        "product_id", "product_category_name", "product_name_lenght", "product_description_lenght",
        "product_photos_qty",
    ],
    "category_translation": ["product_category_name", "product_category_name_english"],
}


def project(df: DataFrame, spec: Mapping[str, str | Column]) -> DataFrame:
    """Columns in the given order, each cast to a type name or computed by an expression; casts are strict."""
    return df.select(
        *[
            F.col(name).cast(kind).alias(name) if isinstance(kind, str) else kind.alias(name)
            for name, kind in spec.items()
        ]
    )


def select_available(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in cols if c in df.columns])


def staged(df: DataFrame, table: str) -> DataFrame:
    """Staging projection of a table; a table without a fixed list passes through."""
    return df.select(*STAGED_COLUMNS[table]) if table in STAGED_COLUMNS else df


def with_literals(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def add_observation_id(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "review_observation_id", **limits: int
) -> DataFrame:
    """Running id from 1 in an explicit row order, for sources whose own id is not unique."""
    return number_rows(df, None, order_by, name, **limits)


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def with_text(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text is present and not blank."""
    from basketry.functions.text import strip_text

    return df.filter(F.col(col).isNotNull() & (strip_text(F.col(col)) != ""))
