"""Raw tables to typed tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.dates import days_between
from basketry.functions.text import clean_text, lower_text, to_int, to_num, to_ts, upper_text
from basketry.operators.columns import project
from basketry.operators.quality import check_not_null, check_unique, summarize
from basketry.operators.sets import union_all
from basketry.sources.tables import write_table

# Raw order columns, all read as text.
RAW_ORDERS = T.StructType(
    [T.StructField(c, T.StringType(), c not in ("order_id", "customer_id", "order_status")) for c in (
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
    )]
)

# How each column of a raw table is read. A column that is not
# listed keeps its content.
CLEANERS = {"text": clean_text, "lower": lower_text, "upper": upper_text, "long": to_int, "double": to_num, "ts": to_ts}
SILVER_RULES: dict[str, dict[str, str]] = {
    "customers": {"customer_zip_code_prefix": "long", "customer_city": "text", "customer_state": "upper"},
    "orders": {
        "order_status": "lower", "order_purchase_timestamp": "ts", "order_approved_at": "ts",
        "order_delivered_carrier_date": "ts", "order_delivered_customer_date": "ts", "order_estimated_delivery_date": "ts",
    },
    "order_items": {"order_item_id": "long", "price": "double", "freight_value": "double", "shipping_limit_date": "ts"},
    "order_payments": {
        "payment_sequential": "long", "payment_type": "lower", "payment_installments": "long", "payment_value": "double",
    },
    "order_reviews": {
        "review_score": "long", "review_comment_title": "text", "review_comment_message": "text",
        "review_creation_date": "ts", "review_answer_timestamp": "ts",
    },
    "products": {
        "product_category_name": "text", "product_name_lenght": "double", "product_description_lenght": "double",
        "product_photos_qty": "double", "product_weight_g": "double", "product_length_cm": "double",
        "product_height_cm": "double", "product_width_cm": "double",
    },
    "sellers": {"seller_zip_code_prefix": "long", "seller_city": "text", "seller_state": "upper"},
    "geolocation": {
        "geolocation_zip_code_prefix": "long", "geolocation_lat": "double", "geolocation_lng": "double",
        "geolocation_city": "text", "geolocation_state": "upper",
    },
    "category_translation": {"product_category_name": "text", "product_category_name_english": "text"},
}
REQUIRED: dict[str, list[str]] = {
    "customers": ["customer_id", "customer_unique_id"],
    "orders": ["order_id", "customer_id", "order_purchase_timestamp"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id"],
    "order_payments": ["order_id", "payment_sequential", "payment_type"],
    "order_reviews": ["review_id", "order_id", "review_score"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "geolocation": ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng"],
    "category_translation": ["product_category_name", "product_category_name_english"],
}
UNIQUE_KEYS: dict[str, list[str]] = {
    "customers": ["customer_id"],
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "category_translation": ["product_category_name"],
}

# Household-domain column types, in output order.
HOUSEHOLD: dict[str, dict[str, str]] = {
    "campaign_desc": {"DESCRIPTION": "text", "CAMPAIGN": "bigint", "START_DAY": "bigint", "END_DAY": "bigint"},
    "campaign_table": {"DESCRIPTION": "text", "household_key": "bigint", "CAMPAIGN": "bigint"},
    "causal_data": {"PRODUCT_ID": "bigint", "STORE_ID": "bigint", "WEEK_NO": "bigint", "display": "text", "mailer": "text"},
    "coupon": {"COUPON_UPC": "bigint", "PRODUCT_ID": "bigint", "CAMPAIGN": "bigint"},
    "coupon_redempt": {"household_key": "bigint", "DAY": "bigint", "COUPON_UPC": "bigint", "CAMPAIGN": "bigint"},
    "hh_demographic": {
        "AGE_DESC": "text", "MARITAL_STATUS_CODE": "text", "INCOME_DESC": "text", "HOMEOWNER_DESC": "text",
        "HH_COMP_DESC": "text", "HOUSEHOLD_SIZE_DESC": "text", "KID_CATEGORY_DESC": "text", "household_key": "bigint",
    },
    "product": {
        "PRODUCT_ID": "bigint", "MANUFACTURER": "bigint", "DEPARTMENT": "text", "BRAND": "text",
        "COMMODITY_DESC": "text", "SUB_COMMODITY_DESC": "text", "CURR_SIZE_OF_PRODUCT": "text",
    },
    "transaction_data": {
        "household_key": "bigint", "BASKET_ID": "bigint", "DAY": "bigint", "PRODUCT_ID": "bigint", "QUANTITY": "bigint",
        "SALES_VALUE": "double", "STORE_ID": "bigint", "RETAIL_DISC": "double", "TRANS_TIME": "text",
        "WEEK_NO": "bigint", "COUPON_DISC": "double", "COUPON_MATCH_DISC": "double",
    },
}
HOUSEHOLD_KEYS: dict[str, list[str]] = {
    "campaign_desc": ["CAMPAIGN"],
    "campaign_table": ["household_key", "CAMPAIGN"],
    "coupon_redempt": ["household_key", "DAY", "COUPON_UPC", "CAMPAIGN"],
    "hh_demographic": ["household_key"],
    "product": ["PRODUCT_ID"],
}


def silver(df: DataFrame, table: str) -> DataFrame:
    """Typed and cleaned rows at source grain; unreadable values become null."""
    rules = SILVER_RULES[table]
    return df.select(
        *[CLEANERS[rules[c]](F.col(c).cast("string")).alias(c) if c in rules else F.col(c) for c in df.columns]
    )


def silver_customers(df: DataFrame) -> DataFrame:
    return silver(df, "customers")


def silver_order_items(df: DataFrame) -> DataFrame:
    return silver(df, "order_items")


def silver_payments(df: DataFrame) -> DataFrame:
    return silver(df, "order_payments")


def silver_reviews(df: DataFrame) -> DataFrame:
    return silver(df, "order_reviews")


def silver_products(df: DataFrame) -> DataFrame:
    return silver(df, "products")


def silver_sellers(df: DataFrame) -> DataFrame:
    return silver(df, "sellers")


def silver_geolocation(df: DataFrame) -> DataFrame:
    return silver(df, "geolocation")


def silver_category_translation(df: DataFrame) -> DataFrame:
    return silver(df, "category_translation")


def silver_checks(df: DataFrame, table: str) -> DataFrame:
    """Required columns and candidate key of a typed table."""
    checks = [check_not_null(df, REQUIRED[table])]
    if table in UNIQUE_KEYS:
        checks.append(check_unique(df, UNIQUE_KEYS[table], "beyond_first"))
    return union_all(*checks)


def household_checks(df: DataFrame, table: str) -> DataFrame:
    keys = HOUSEHOLD_KEYS[table]
    return check_not_null(df, keys).unionByName(check_unique(df, keys, "groups"))


def require(checks: DataFrame, what: str) -> None:
    """Raise unless every check passed."""
    if summarize(checks).first()["failed"]:
        raise ValueError(f"{what}: validation failed")


def silver_household(df: DataFrame, table: str) -> DataFrame:
    """Household-domain table: strict casts, space-trimmed text, fixed column order."""
    spec = {
        c: F.trim(F.col(c).cast("string")) if kind == "text" else kind for c, kind in HOUSEHOLD[table].items()
    }
    return project(df, spec)


def write_household(raw: Mapping[str, DataFrame], folder: str, compression: str = "zstd") -> dict[str, int]:
    """Cleans and writes each household table below `folder`; refuses to overwrite, and raises where the written rows are not those of the source."""
    return {
        name: write_table(silver_household(df, name), f"{folder}/{name}", mode="errorifexists", compression=compression, reconcile=True)
        for name, df in raw.items()
    }


def delivery_delay_days() -> Column:
    """Days from the estimated to the actual delivery, null unless both are known."""
    return days_between(F.col("order_estimated_delivery_date"), F.col("order_delivered_customer_date"))


def late_flag(null_late_as_zero: bool) -> Column:
    """1 when delivered after the estimate. Without a delay: 0, or null."""
    late = (F.col("delivery_delay_days") > 0).cast("int")
    return F.coalesce(late, F.lit(0)) if null_late_as_zero else late


def silver_orders(raw: DataFrame, null_late_as_zero: bool = True) -> DataFrame:
    """Orders parsed and standardized, with delay and late flag."""
    typed = silver(raw, "orders").withColumn("order_status", F.lower(F.trim("order_status")))
    return typed.withColumn("delivery_delay_days", delivery_delay_days()).withColumn(
        "is_late_delivery", late_flag(null_late_as_zero)
    )


def staged_orders(orders: DataFrame) -> DataFrame:
    """Typed orders with delay and a late flag that stays null while a date is missing."""
    named = orders.select(*RAW_ORDERS.fieldNames())
    return named.withColumn("delivery_delay_days", delivery_delay_days()).withColumn(
        "is_late_delivery", late_flag(null_late_as_zero=False)
    )
