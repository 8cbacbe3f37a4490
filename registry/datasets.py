"""Silver and Gold datasets (inventory G)."""

from __future__ import annotations

from registry import query
from registry.inputs import gold_table, items, silver_table
from registry.oracle import sql
from tidelake.plans import gold

_SILVER = {
    "g1_silver_orders": ("silver_orders", "s_orders"),
    "g2_silver_order_items": ("silver_order_items", "s_order_items"),
    "g3_silver_payments": ("silver_payments", "s_payments"),
    "g4_silver_customers": ("silver_customers", "s_customers"),
    "g5_silver_customer_contact": ("silver_customer_contact", "s_contact"),
    "g6_silver_products": ("silver_products", "s_products"),
    "g7_silver_product_categories": ("silver_product_categories", "s_categories"),
    "g8_silver_geolocation": ("silver_geolocation", "s_geolocation"),
    "g9_silver_reviews": ("silver_reviews", "s_reviews"),
    "g10_silver_sellers": ("silver_sellers", "s_sellers"),
}
_GOLD = {
    "g13_gold_daily_sales": ("gold_daily_sales", "g_daily"),
    "g14_gold_sales_by_state": ("gold_sales_by_state", "g_state"),
    "g15_gold_product_category_revenue": ("gold_product_category_revenue", "g_category"),
    "g16_gold_customer_order_summary": ("gold_customer_order_summary", "g_customer"),
    "g17_gold_public_sales_dashboard": ("gold_public_sales_dashboard", "g_public"),
}

for _name, (_dataset, _cte) in _SILVER.items():
    query(_name, sql(f"select * from {_cte}"))(
        lambda spark, sf_dir, d=_dataset: silver_table(spark, sf_dir, d)
    )

query("g11_item_enriched", sql("select * from items"))(items)


@query("g12_order_financials", sql("select * from financials"))
def order_financials(spark, sf_dir):
    return gold.order_financials(items(spark, sf_dir))


for _name, (_dataset, _cte) in _GOLD.items():
    query(_name, sql(f"select * from {_cte}"))(
        lambda spark, sf_dir, d=_dataset: gold_table(spark, sf_dir, d)
    )
