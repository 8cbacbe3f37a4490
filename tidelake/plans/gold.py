"""Gold: sales of delivered orders by day, state, category and customer.

Money is summed as exact decimals, so every figure is the same under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import scalar as S
from tidelake.operators import ranking

GOLD_INPUTS = [
    "silver_orders",
    "silver_order_items",
    "silver_customers",
    "silver_products",
    "silver_product_categories",
]


ORDER = ("order_id", "customer_id", "customer_unique_id", "customer_state", "order_date")
GROUP = ("order_date", "customer_state", "product_category_name_english")

# Marks of the item table: column -> the columns of which a row is the first one.
MARKS = {
    "_first_of_product": (*ORDER, "product_id"),
    "_first_of_order": ("order_id", *GROUP),
}

# A filter of order ids has 2 ** 20 words of 64 bits, whatever the number of orders: 8 MB.
FILTER_WORDS = 2**20


def among(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items without most of those whose order is not in ``orders``; no other item is lost.

    An order id has its bit in a filter of fixed size, which is sent to the tasks. An id whose bit
    is set by another one passes: a join decides.
    """
    slot = F.pmod(F.xxhash64("order_id"), F.lit(64 * FILTER_WORDS))
    word, bit = F.floor(slot / 64), F.expr("shiftleft(1L, cast(pmod(xxhash64(order_id), 64) as int))")
    places = orders.select(word.alias("_word"), bit.alias("_bit"))
    words = places.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    placed = items.withColumns({"_item_word": word, "_item_bit": bit})
    # At most FILTER_WORDS rows.
    hit = (F.col("_item_word") == F.col("_word")) & (F.col("_bits").bitwiseAND(F.col("_item_bit")) != 0)
    return placed.join(F.broadcast(words), hit, "left_semi").select(*items.columns)


def _packed(items: DataFrame) -> DataFrame:
    """Amounts as numbers of cents, and as doubles only where they are no such number.

    A double of cents has eight odd bytes, a small whole number two or three: rows that are shuffled
    get a third shorter. A total that is the sum of its parts is left out.
    """
    made = {}
    for name in ("price", "freight_value"):
        cents = F.rint(F.col(name) * 100).try_cast("bigint")
        whole = F.coalesce(cents / F.lit(100.0) == F.col(name), F.lit(False))
        made |= {f"_{name}": F.when(whole, cents), name: F.when(~whole, F.col(name))}
    total = F.col("item_total_value")
    same = total.eqNullSafe(F.col("price") + F.col("freight_value"))
    return items.withColumns(made | {"_sum": same, "item_total_value": F.when(~same, total)})


def _unpacked(items: DataFrame) -> DataFrame:
    amounts = {c: F.coalesce(c, F.col(f"_{c}") / F.lit(100.0)) for c in ("price", "freight_value")}
    total = F.when(F.col("_sum"), F.col("price") + F.col("freight_value"))
    return items.withColumns(amounts).withColumn(
        "item_total_value", total.otherwise(F.col("item_total_value"))
    )


def marked(items: DataFrame) -> DataFrame:
    """The item table with its marks, so that orders and products are counted by plain sums."""

    def first(columns: tuple[str, ...]) -> Column:
        return F.row_number().over(Window.partitionBy(*columns).orderBy(columns[-1])) == 1

    return items.withColumns({name: first(columns) for name, columns in MARKS.items()})


def _distinct(items: DataFrame, column: str, mark: str) -> Column:
    """Distinct values that are not NULL, by the mark where the items have it."""
    if mark in items.columns:
        return F.count_if(F.col(mark) & F.col(column).isNotNull())
    return F.count_distinct(column)


def item_enriched(silver: dict[str, DataFrame], by_order: bool = False) -> DataFrame:
    """Items of delivered orders with their customer, state, date and category.

    ``by_order`` leaves the rows of an order together, so that what is summed by order and written
    again is combined before it is shuffled.
    """
    delivered = (
        silver["silver_orders"]
        .where(
            (F.lower("order_status") == "delivered") & F.col("order_purchase_timestamp").isNotNull()
        )
        .select("order_id", "customer_id", F.to_date("order_purchase_timestamp").alias("order_date"))
    )
    customers = silver["silver_customers"].select(
        "customer_id", "customer_unique_id", F.upper("customer_state").alias("customer_state")
    )
    products = silver["silver_products"].select(
        "product_id", F.lower("product_category_name").alias("product_category_name")
    )
    categories = silver["silver_product_categories"].select(
        F.lower("product_category_name").alias("product_category_name"),
        F.lower("product_category_name_english").alias("product_category_name_english"),
    )
    # Small chains first: the item table is shuffled once per large key only.
    orders = delivered.join(customers, "customer_id", "left")
    named_products = products.join(categories, "product_category_name", "left")
    items = silver["silver_order_items"]
    if by_order:
        named = _packed(among(items, delivered)).join(named_products, "product_id", "left")
        joined = _unpacked(named.join(orders, "order_id"))
    else:
        joined = items.join(orders, "order_id").join(named_products, "product_id", "left")
    return joined.select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        "customer_id",
        "customer_unique_id",
        F.coalesce("customer_state", F.lit("UNKNOWN")).alias("customer_state"),
        "order_date",
        F.coalesce("product_category_name_english", F.lit("unknown")).alias(
            "product_category_name_english"
        ),
        *[
            F.coalesce(c, F.lit(0.0)).alias(c)
            for c in ("price", "freight_value", "item_total_value")
        ],
    )


def _sums(**names: str) -> list[Column]:
    return [F.sum(S.money(column)).alias(name) for name, column in names.items()]


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: S.rounded(F.col(c)) for c in columns})


REVENUE = ("product_revenue", "freight_revenue", "total_revenue")


def order_financials(items: DataFrame) -> DataFrame:
    totals = items.groupBy(*ORDER).agg(
        F.count("order_item_id").alias("total_items"),
        _distinct(items, "product_id", "_first_of_product").alias("distinct_products"),
        *_sums(
            product_revenue="price",
            freight_revenue="freight_value",
            total_revenue="item_total_value",
        ),
    )
    return _as_double(totals, *REVENUE)


def _sales_by(financials: DataFrame, key: str) -> DataFrame:
    return financials.groupBy(key).agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.count_distinct("customer_unique_id").alias("unique_customers"),
        F.sum("total_items").alias("units_sold"),
        *_sums(**{c: c for c in REVENUE}),
    )


def daily_sales(financials: DataFrame) -> DataFrame:
    days = _sales_by(financials, "order_date").withColumns(
        {
            "average_order_value": S.rounded_ratio(
                F.col("total_revenue"), F.col("total_orders")
            ),
            "average_freight_value": S.rounded_ratio(
                F.col("freight_revenue"), F.col("total_orders")
            ),
        }
    )
    return _as_double(days, *REVENUE)


def sales_by_state(financials: DataFrame) -> DataFrame:
    states = _sales_by(financials, "customer_state").withColumn(
        "average_order_value",
        S.rounded_ratio(F.col("total_revenue"), F.col("total_orders")),
    )
    return _as_double(states, *REVENUE)


def product_category_revenue(items: DataFrame) -> DataFrame:
    totals = items.groupBy("product_category_name_english").agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.count_distinct("customer_unique_id").alias("unique_customers"),
        F.count("order_item_id").alias("units_sold"),
        *_sums(
            product_revenue="price",
            freight_revenue="freight_value",
            total_revenue="item_total_value",
        ),
        F.count("price").alias("priced_items"),
    )
    totals = totals.withColumn(
        "average_item_price",
        S.rounded_ratio(F.col("product_revenue"), F.col("priced_items")),
    ).drop("priced_items")
    shared = ranking.with_share_of_total(totals, "total_revenue", "revenue_share_pct")
    return _as_double(shared, *REVENUE)


def customer_order_summary(items: DataFrame) -> DataFrame:
    key = "customer_unique_id"
    totals = items.groupBy(key).agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("latest_order_date"),
        F.count_distinct("order_id").alias("total_orders"),
        F.count("order_item_id").alias("total_items"),
        F.count_distinct("product_id").alias("distinct_products"),
        *_sums(
            product_revenue="price", freight_revenue="freight_value", total_spend="item_total_value"
        ),
    )
    # The items are read twice: give them as a written table.
    states = ranking.representative_mode(items, [key], "customer_state")
    joined = totals.join(states, key, "left")
    return joined.select(
        key,
        F.coalesce("customer_state", F.lit("UNKNOWN")).alias("customer_state"),
        "first_order_date",
        "latest_order_date",
        "total_orders",
        "total_items",
        "distinct_products",
        *[S.rounded(F.col(c)).alias(c) for c in ("product_revenue", "freight_revenue", "total_spend")],
        S.rounded_ratio(F.col("total_spend"), F.col("total_orders")).alias(
            "average_order_value"
        ),
    )


def public_sales_dashboard(items: DataFrame) -> DataFrame:
    """Allow-listed columns only: no identifier leaves the grouping."""
    totals = items.groupBy(*GROUP).agg(
        _distinct(items, "order_id", "_first_of_order").alias("total_orders"),
        F.count("order_item_id").alias("units_sold"),
        *_sums(
            product_revenue="price",
            freight_revenue="freight_value",
            total_revenue="item_total_value",
        ),
    )
    return _as_double(totals, *REVENUE)


# Gold dataset -> (builder, whether it starts from order_financials).
GOLD = {
    "gold_daily_sales": (daily_sales, True),
    "gold_sales_by_state": (sales_by_state, True),
    "gold_product_category_revenue": (product_category_revenue, False),
    "gold_customer_order_summary": (customer_order_summary, False),
    "gold_public_sales_dashboard": (public_sales_dashboard, False),
}


def build_gold(name: str, items: DataFrame, financials: DataFrame | None = None) -> DataFrame:
    """One Gold dataset over the enriched items (or the order totals made from them)."""
    builder, from_orders = GOLD[name]
    if not from_orders:
        return builder(items)
    return builder(order_financials(items) if financials is None else financials)
