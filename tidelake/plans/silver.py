"""Silver: raw text tables cleaned, typed and made distinct.

Duplicates are removed on the cleaned values before any change of case, so two records
that differ only in case stay two records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions import keys
from tidelake.functions import scalar as S
from tidelake.operators import ranking, rejects
from tidelake.operators.quality import union_all
from tidelake.session import written

# Spelling corrections of raw column names.
PRODUCT_RENAMES = {
    "product_name_lenght": "product_name_length",
    "product_description_lenght": "product_description_length",
}


# Silver dataset -> kinds of its typed columns; every other column is text.
KINDS = {
    "silver_orders": {
        c: "timestamp"
        for c in (
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        )
    },
    "silver_order_items": {
        "order_item_id": "bigint",
        "shipping_limit_date": "timestamp",
        "price": "money",
        "freight_value": "money",
    },
    "silver_payments": {
        "payment_sequential": "bigint",
        "payment_installments": "bigint",
        "payment_value": "money",
    },
    "silver_customers": {"customer_zip_code_prefix": "bigint"},
    "silver_customer_contact": {"marketing_consent": "consent"},
    "silver_products": {
        c: "double"
        for c in (
            "product_name_length",
            "product_description_length",
            "product_photos_qty",
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
        )
    },
    "silver_product_categories": {},
    "silver_geolocation": {
        "geolocation_zip_code_prefix": "bigint",
        "geolocation_lat": "double",
        "geolocation_lng": "double",
    },
    "silver_reviews": {
        "review_score": "bigint",
        "review_creation_date": "timestamp",
        "review_answer_timestamp": "timestamp",
    },
    "silver_sellers": {"seller_zip_code_prefix": "bigint"},
}

# Silver dataset -> raw columns that name a record in the ledger of lost cells.
RECORD_KEYS = {
    "silver_orders": ["order_id"],
    "silver_order_items": ["order_id", "order_item_id"],
    "silver_payments": ["order_id", "payment_sequential"],
    "silver_customers": ["customer_id"],
    "silver_customer_contact": ["customer_id"],
    "silver_products": ["product_id"],
    "silver_product_categories": ["product_category_name"],
    "silver_geolocation": ["geolocation_zip_code_prefix"],
    "silver_reviews": ["review_id", "order_id"],
    "silver_sellers": ["seller_id"],
}


# How repeated rows are dropped; ``distinct_rows`` reads its table twice and shuffles less.
Distinct = Callable[[DataFrame], DataFrame]


def _typed(df: DataFrame, dataset: str, distinct: Distinct) -> DataFrame:
    """Clean every column, read the typed ones, drop repeated rows."""
    kinds = {c: KINDS[dataset].get(c, "string") for c in df.columns}
    read = S.typed_cells(df, kinds)
    return distinct(read.select(*[F.col(f"_cell{i}").alias(c) for i, c in enumerate(kinds)]))


def silver_orders(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    orders = _typed(raw, "silver_orders", distinct)
    return orders.withColumns(
        {
            "order_purchase_date": F.to_date("order_purchase_timestamp"),
            "delivery_delay_days": S.fractional_days_between(
                "order_estimated_delivery_date", "order_delivered_customer_date"
            ),
            "actual_delivery_days": S.fractional_days_between(
                "order_purchase_timestamp", "order_delivered_customer_date"
            ),
        }
    )


def silver_order_items(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    items = _typed(raw, "silver_order_items", distinct)
    return items.withColumn("item_total_value", F.col("price") + F.col("freight_value"))


def silver_payments(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    return _typed(raw, "silver_payments", distinct)


def silver_customers(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    return _typed(raw, "silver_customers", distinct).withColumns(
        {"customer_city": F.lower("customer_city"), "customer_state": F.upper("customer_state")}
    )


def silver_sellers(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    return _typed(raw, "silver_sellers", distinct).withColumns(
        {"seller_city": F.lower("seller_city"), "seller_state": F.upper("seller_state")}
    )


def silver_customer_contact(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    return _typed(raw, "silver_customer_contact", distinct).withColumn(
        "synthetic_email", F.lower("synthetic_email")
    )


def silver_products(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    return _typed(raw.withColumnsRenamed(PRODUCT_RENAMES), "silver_products", distinct)


def silver_product_categories(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    return _typed(raw, "silver_product_categories", distinct).withColumns(
        {
            "product_category_name": F.lower("product_category_name"),
            "product_category_name_english": F.lower("product_category_name_english"),
        }
    )


def geolocation_records(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    """Distinct located records with a readable postal prefix, case-normalised."""
    return (
        _typed(raw, "silver_geolocation", distinct)
        .where(F.col("geolocation_zip_code_prefix").isNotNull())
        .withColumns(
            {
                "geolocation_city": F.lower("geolocation_city"),
                "geolocation_state": F.upper("geolocation_state"),
            }
        )
    )


def silver_geolocation(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    """One row per postal prefix: median position, most frequent city and state."""
    key = "geolocation_zip_code_prefix"
    # Four aggregates read the records: compute them once.
    records = written(geolocation_records(raw, distinct), "geolocation")
    located = records.groupBy(key).agg(F.count(F.lit(1)).alias("source_location_records"))
    axes = ("geolocation_lat", "geolocation_lng")
    middle = ranking.exact_quantiles(records, [key], {a: (a, 0.5) for a in axes})
    located = located.join(middle.withColumns({a: F.round(a, 10) for a in axes}), key, "left")
    for place in ("geolocation_city", "geolocation_state"):
        located = located.join(ranking.representative_mode(records, [key], place), key, "left")
    return located.select(
        key,
        "geolocation_lat",
        "geolocation_lng",
        "geolocation_city",
        "geolocation_state",
        "source_location_records",
    )


def silver_reviews(raw: DataFrame, distinct: Distinct = DataFrame.distinct) -> DataFrame:
    """Distinct reviews; records that share all identifying fields get a number each."""
    identity = ["review_id", "order_id", "review_creation_date", "review_answer_timestamp"]
    records = written(_typed(raw, "silver_reviews", distinct), "reviews")
    order = [
        F.coalesce("review_comment_title", F.lit("")),
        F.coalesce("review_comment_message", F.lit("")),
        F.coalesce("review_score", F.lit(-1)),
    ]
    numbered = ranking.occurrence_number(records, identity, order, "review_occurrence")
    return numbered.select(
        keys.review_key(*identity, "review_occurrence").alias("review_record_id"), *numbered.columns
    )


# Silver dataset -> (raw table, builder).
SILVER = {
    "silver_orders": ("orders", silver_orders),
    "silver_order_items": ("order_items", silver_order_items),
    "silver_payments": ("order_payments", silver_payments),
    "silver_customers": ("customers", silver_customers),
    "silver_customer_contact": ("customer_contact", silver_customer_contact),
    "silver_products": ("products", silver_products),
    "silver_product_categories": (
        "product_category_name_translation",
        silver_product_categories,
    ),
    "silver_geolocation": ("geolocation", silver_geolocation),
    "silver_reviews": ("order_reviews", silver_reviews),
    "silver_sellers": ("sellers", silver_sellers),
}


def build_silver(raw: dict[str, DataFrame], names: list[str] | None = None) -> dict:
    return {n: SILVER[n][1](raw[SILVER[n][0]]) for n in names or SILVER}


def rejected_cells(raw: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """Ledger of the raw cells that the named Silver datasets lose (all by default)."""
    parts = []
    for name in names or SILVER:
        if KINDS[name]:
            source = raw[SILVER[name][0]].withColumnsRenamed(PRODUCT_RENAMES)
            parts.append(rejects.rejected_cells(source, name, RECORD_KEYS[name], KINDS[name]))
    return union_all(parts)
