"""Keys, columns, contracts and checks of the Silver and Gold datasets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions import keys
from tidelake.functions.scalar import money
from tidelake.operators import quality as Q
from tidelake.operators import rejects
from tidelake.operators.contracts import (
    FORBIDDEN_PUBLIC_COLUMNS,
    Contract,
    ContractColumn,
    contract_row_checks,
    forbidden_name_parts,
    metadata_results,
    set_results,
)
from tidelake.operators.joins import Edge, edge_keys
from tidelake.plans.silver import KINDS
from tidelake.session import small_table

# Silver keys.
SILVER_KEYS = {
    "silver_orders": ["order_id"],
    "silver_order_items": ["order_id", "order_item_id"],
    "silver_payments": ["order_id", "payment_sequential"],
    "silver_customers": ["customer_id"],
    "silver_customer_contact": ["customer_id"],
    "silver_products": ["product_id"],
    "silver_product_categories": ["product_category_name"],
    "silver_geolocation": ["geolocation_zip_code_prefix"],
    "silver_reviews": ["review_record_id"],
    "silver_sellers": ["seller_id"],
}

# Columns a Silver dataset must have.
SILVER_REQUIRED = {
    "silver_orders": [
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_purchase_date",
        "delivery_delay_days",
        "actual_delivery_days",
    ],
    "silver_order_items": [
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        "price",
        "freight_value",
        "item_total_value",
    ],
    "silver_payments": [
        "order_id",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        "payment_value",
    ],
    "silver_customers": [
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
    ],
    "silver_customer_contact": ["customer_id", "synthetic_email", "synthetic_phone"],
    "silver_products": [
        "product_id",
        "product_category_name",
        "product_name_length",
        "product_description_length",
    ],
    "silver_product_categories": ["product_category_name", "product_category_name_english"],
    "silver_geolocation": [
        "geolocation_zip_code_prefix",
        "geolocation_lat",
        "geolocation_lng",
        "geolocation_city",
        "geolocation_state",
        "source_location_records",
    ],
    "silver_reviews": ["review_record_id", "review_id", "order_id", "review_score"],
    "silver_sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
}

# Fixed values: (child, check, child key, parent, parent key).
FOREIGN_KEYS = [
    ("silver_orders", "customer_foreign_key_valid", "customer_id", "silver_customers", "customer_id"),
    ("silver_order_items", "order_foreign_key_valid", "order_id", "silver_orders", "order_id"),
    ("silver_payments", "order_foreign_key_valid", "order_id", "silver_orders", "order_id"),
    ("silver_order_items", "product_foreign_key_valid", "product_id", "silver_products", "product_id"),
    ("silver_order_items", "seller_foreign_key_valid", "seller_id", "silver_sellers", "seller_id"),
    ("silver_reviews", "order_foreign_key_valid", "order_id", "silver_orders", "order_id"),
    (
        "silver_customer_contact",
        "customer_foreign_key_valid",
        "customer_id",
        "silver_customers",
        "customer_id",
    ),
]

# Gold zones, keys and ordered columns with their contract types.
GOLD_ZONES = {
    "gold_daily_sales": "gold/internal",
    "gold_sales_by_state": "gold/internal",
    "gold_product_category_revenue": "gold/internal",
    "gold_customer_order_summary": "gold/internal",
    "gold_public_sales_dashboard": "gold/public",
}
GOLD_KEYS = {
    "gold_daily_sales": ["order_date"],
    "gold_sales_by_state": ["customer_state"],
    "gold_product_category_revenue": ["product_category_name_english"],
    "gold_customer_order_summary": ["customer_unique_id"],
    "gold_public_sales_dashboard": [
        "order_date",
        "customer_state",
        "product_category_name_english",
    ],
}
GOLD_COLUMNS = {
    "gold_daily_sales": {
        "order_date": "date",
        "total_orders": "integer",
        "unique_customers": "integer",
        "units_sold": "integer",
        "product_revenue": "decimal",
        "freight_revenue": "decimal",
        "total_revenue": "decimal",
        "average_order_value": "decimal",
        "average_freight_value": "decimal",
    },
    "gold_sales_by_state": {
        "customer_state": "string",
        "total_orders": "integer",
        "unique_customers": "integer",
        "units_sold": "integer",
        "product_revenue": "decimal",
        "freight_revenue": "decimal",
        "total_revenue": "decimal",
        "average_order_value": "decimal",
    },
    "gold_product_category_revenue": {
        "product_category_name_english": "string",
        "total_orders": "integer",
        "unique_customers": "integer",
        "units_sold": "integer",
        "product_revenue": "decimal",
        "freight_revenue": "decimal",
        "total_revenue": "decimal",
        "average_item_price": "decimal",
        "revenue_share_pct": "decimal",
    },
    "gold_customer_order_summary": {
        "customer_unique_id": "string",
        "customer_state": "string",
        "first_order_date": "date",
        "latest_order_date": "date",
        "total_orders": "integer",
        "total_items": "integer",
        "distinct_products": "integer",
        "product_revenue": "decimal",
        "freight_revenue": "decimal",
        "total_spend": "decimal",
        "average_order_value": "decimal",
    },
    "gold_public_sales_dashboard": {
        "order_date": "date",
        "customer_state": "string",
        "product_category_name_english": "string",
        "total_orders": "integer",
        "units_sold": "integer",
        "product_revenue": "decimal",
        "freight_revenue": "decimal",
        "total_revenue": "decimal",
    },
}
# Grains, classifications and columns with personal data of the contracts.
GRAINS = {
    "gold_daily_sales": "one row per order_date",
    "gold_sales_by_state": "one row per customer_state",
    "gold_product_category_revenue": "one row per translated product category",
    "gold_customer_order_summary": "one row per customer_unique_id",
    "gold_public_sales_dashboard": (
        "one row per order_date, customer_state and product category"
    ),
}
CLASSIFICATIONS = {
    "gold_customer_order_summary": "Confidential",
    "gold_public_sales_dashboard": "Public-Safe",
}
PII_COLUMNS = {"gold_customer_order_summary": ["customer_unique_id"]}


def gold_contract(dataset: str) -> Contract:
    public = dataset == "gold_public_sales_dashboard"
    confidential = dataset == "gold_customer_order_summary"
    return Contract(
        dataset=dataset,
        version="1.0.0",
        owner="Analytics Team",
        classification=CLASSIFICATIONS.get(dataset, "Internal"),
        grain=GRAINS[dataset],
        freshness_slo_hours=24.0,
        allowed_destinations=[GOLD_ZONES[dataset]],
        forbidden_destinations=["gold/public"] if confidential else [],
        primary_key=GOLD_KEYS[dataset],
        columns=[
            ContractColumn(name, kind, True, name in PII_COLUMNS.get(dataset, []))
            for name, kind in GOLD_COLUMNS[dataset].items()
        ],
        compatibility={
            "allow_add_optional_column": not public,
            "allow_remove_required_column": False,
            "allow_type_change_required_column": False,
        },
        forbidden_fields=FORBIDDEN_PUBLIC_COLUMNS if public else [],
    )


# ---- Silver ------------------------------------------------------------------------


def silver_range_checks(name: str) -> list[Q.Check]:
    gap = F.abs(F.col("item_total_value") - (F.col("price") + F.col("freight_value")))
    rules = {
        "silver_order_items": [
            *Q.non_negative(["price", "freight_value"]),
            Q.violations(
                "item_total_reconciles",
                F.col("item_total_value").isNull() | (gap > Q.TOTAL_TOLERANCE),
            ),
        ],
        "silver_reviews": [Q.within("review_score_between_1_and_5", "review_score", 1, 5)],
        "silver_geolocation": [
            Q.within("latitude_valid", "geolocation_lat", -90, 90),
            Q.within("longitude_valid", "geolocation_lng", -180, 180),
        ],
        "silver_customer_contact": [
            Q.violations("consent_valid", F.col("marketing_consent").isNull())
        ],
    }
    return rules.get(name, [])


EDGES = [Edge(f"{child}/{check}", child, *rest) for child, check, *rest in FOREIGN_KEYS]
COVERAGE = Edge(
    "silver_customer_contact/customer_contact_coverage",
    "silver_customer_contact",
    "customer_id",
    "silver_customers",
    "customer_id",
)

# Values of row checks that are measured already: dataset -> check name -> value.
Counters = dict[str, dict[str, Any]]


def tables_of(edges: list[Edge]) -> list[str]:
    """The datasets that the edges connect."""
    return list(dict.fromkeys(t for e in edges for t in (e.child, e.parent)))


def foreign_key_checks(silver: dict[str, DataFrame]) -> DataFrame:
    return Q.orphan_results(edge_keys(silver, EDGES), EDGES)


def silver_row_checks(name: str) -> list[Q.Check]:
    return [Q.key_not_null(SILVER_KEYS[name]), *silver_range_checks(name)]


def _row_results(
    frames: dict[str, DataFrame], checks: dict[str, list[Q.Check]], counters: Counters | None
) -> DataFrame:
    """Results of row checks: from what the writes counted, or else from a pass over each dataset."""
    counters = counters or {n: Q.measure(frames[n], checks[n]) for n in checks}
    rows = [(n, c, counters[n][c.name]) for n, some in checks.items() for c in some]
    return Q.known_results(next(iter(frames.values())).sparkSession, rows)


def validate_silver(silver: dict[str, DataFrame], counters: Counters | None = None) -> DataFrame:
    """Structure, keys, ranges, foreign keys and contact coverage of all Silver datasets."""
    keys_of_edges = edge_keys(silver, [*EDGES, COVERAGE])
    return Q.union_all(
        [
            Q.required_columns_of({n: (silver[n], SILVER_REQUIRED[n]) for n in SILVER_KEYS}),
            _row_results(silver, {n: silver_row_checks(n) for n in SILVER_KEYS}, counters),
            Q.unique_rows_and_keys({n: (silver[n], key) for n, key in SILVER_KEYS.items()}),
            Q.orphan_results(keys_of_edges, EDGES),
            Q.covered(keys_of_edges, COVERAGE),
        ]
    )


def contact_coverage(silver: dict[str, DataFrame]) -> DataFrame:
    return Q.covered(edge_keys(silver, [COVERAGE]), COVERAGE)


# Declared tests, as the columns of each dataset that are never NULL, and whether
# each of their values occurs once.
DECLARED_TESTS = {
    "silver_orders": {"order_id": True},
    "silver_customer_contact": {"customer_id": True},
    "silver_customers": {"customer_id": True},
    "silver_geolocation": {"geolocation_zip_code_prefix": True},
    "silver_order_items": {"order_id": False, "order_item_id": False},
    "silver_payments": {"order_id": False, "payment_sequential": False},
    "silver_product_categories": {"product_category_name": True},
    "silver_products": {"product_id": True},
    "silver_reviews": {"review_record_id": True},
    "silver_sellers": {"seller_id": True},
    "gold_daily_sales": {"order_date": True},
    "gold_sales_by_state": {"customer_state": True},
    "gold_product_category_revenue": {"product_category_name_english": True},
    "gold_customer_order_summary": {"customer_unique_id": True},
    "gold_public_sales_dashboard": {
        "order_date": False,
        "customer_state": False,
        "product_category_name_english": False,
    },
}

# Checks of each suite: Silver has the two business rules beside the 53 of the first baseline.
EXPECTED_CHECKS = {"silver_validation": 55, "gold_validation": 110, "gold_contract_validation": 211}
EXPECTED_DATASETS = {"silver_validation": 10, "gold_validation": 5, "gold_contract_validation": 5}


def validate_typing(silver: dict[str, DataFrame], rejected: DataFrame) -> DataFrame:
    """Lost cells by dataset, column and reason, and item amounts that no sum can hold."""
    amounts = [
        Q.violations(f"{c}_within_money", F.col(c).isNotNull() & money(c).isNull())
        for c in ("price", "freight_value", "item_total_value")
    ]
    items = Q.run_checks(silver["silver_order_items"], "silver_order_items", amounts)
    return rejects.ledger_checks(rejected, KINDS).unionByName(items)


# ---- Gold --------------------------------------------------------------------------

# Counts and amounts of Gold are never negative.
GOLD_NON_NEGATIVE = {
    name: [c for c, kind in columns.items() if kind in ("integer", "decimal")]
    for name, columns in GOLD_COLUMNS.items()
}


def _orders_value() -> Q.Check:
    return Q.average_correct("total_revenue", "total_orders", "average_order_value")


def gold_rule_checks(name: str) -> list[Q.Check]:
    specific = {
        "gold_daily_sales": lambda: [
            Q.components_reconcile("total_revenue"),
            _orders_value(),
            Q.average_correct("freight_revenue", "total_orders", "average_freight_value"),
            Q.valid_date("order_date"),
            Q.not_above("unique_customers_not_above_orders", "unique_customers", "total_orders"),
        ],
        "gold_sales_by_state": lambda: [
            Q.components_reconcile("total_revenue"),
            _orders_value(),
            Q.violations(
                "customer_state_format_valid",
                ~F.coalesce(keys.is_state_code("customer_state"), F.lit(False)),
            ),
        ],
        "gold_product_category_revenue": lambda: [
            Q.components_reconcile("total_revenue"),
            Q.average_correct("product_revenue", "units_sold", "average_item_price"),
            Q.sums_to_hundred("revenue_share_sums_to_100", "revenue_share_pct"),
        ],
        "gold_customer_order_summary": lambda: [
            Q.components_reconcile("total_spend"),
            Q.average_correct("total_spend", "total_orders", "average_order_value"),
            Q.valid_date("first_order_date"),
            Q.valid_date("latest_order_date"),
            Q.not_above(
                "first_order_not_after_latest_order", "first_order_date", "latest_order_date"
            ),
            Q.not_above("distinct_products_not_above_items", "distinct_products", "total_items"),
        ],
        "gold_public_sales_dashboard": lambda: [
            Q.components_reconcile("total_revenue"),
            Q.valid_date("order_date"),
        ],
    }
    return [*Q.non_negative(GOLD_NON_NEGATIVE[name]), *specific[name]()]


# An order of several categories stands in several rows of these.
_REPEATS_ORDERS = ("gold_product_category_revenue", "gold_public_sales_dashboard")


def _first_of(name: str, *columns: str) -> str:
    return next(c for c in columns if c in GOLD_COLUMNS[name])


# Gold dataset -> (orders, items, total) columns; None where the grain repeats orders.
_TOTALS = {
    name: (
        None if name in _REPEATS_ORDERS else "total_orders",
        _first_of(name, "units_sold", "total_items"),
        _first_of(name, "total_revenue", "total_spend"),
    )
    for name in GOLD_COLUMNS
}


def source_totals(silver: dict[str, DataFrame]) -> DataFrame:
    """Delivered orders, their items and amounts straight from Silver: (source, expected)."""
    delivered = silver["silver_orders"].where(F.lower("order_status") == "delivered")
    lines = silver["silver_order_items"].join(
        delivered.select("order_id"), "order_id", "left_semi"
    )
    orders = delivered.agg(F.count_distinct("order_id").cast("decimal(38,0)").alias("orders"))
    amounts = {"product": "price", "freight": "freight_value", "total": "item_total_value"}
    sums = lines.agg(
        F.count(F.lit(1)).cast("decimal(38,0)").alias("items"),
        *[F.coalesce(F.sum(money(c)), F.lit(0)).alias(n) for n, c in amounts.items()],
    )
    return _melt(orders, "source", "expected").unionByName(_melt(sums, "source", "expected"))


def _melt(row: DataFrame, key: str, value: str) -> DataFrame:
    """One row per column of a one-row frame, values as decimal(38,2)."""
    entries = [
        F.struct(F.lit(c).alias(key), F.col(c).cast("decimal(38,2)").alias(value))
        for c in row.columns
    ]
    return row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def gold_totals(name: str) -> list[Q.Check]:
    """Totals of a Gold dataset that must agree with Silver; named like the totals of Silver."""
    orders, units, total = _TOTALS[name]
    columns = {"items": units, "total": total}
    columns.update({"product": "product_revenue", "freight": "freight_revenue"})
    if orders:
        columns["orders"] = orders
    return [Q.Check(source, F.sum(money(c))) for source, c in columns.items()]


def reconcile_with_source(
    gold: dict[str, DataFrame], silver: dict[str, DataFrame], counters: Counters | None = None
) -> DataFrame:
    """Order, item and revenue totals of each Gold dataset against Silver."""
    spark = next(iter(gold.values())).sparkSession
    rows = []
    for name in _TOTALS:
        totals = gold_totals(name)
        found = counters[name] if counters else Q.measure(gold[name], totals)
        rows += [
            (name, t.name, None if found[t.name] is None else str(found[t.name])) for t in totals
        ]
    observed = small_table(spark, rows, "dataset string, source string, observed string")
    observed = observed.withColumn("observed", F.col("observed").cast("decimal(38,2)"))
    names = F.create_map(
        *[
            F.lit(v)
            for pair in (
                ("orders", "delivered_order_count_reconciles"),
                ("items", "delivered_item_count_reconciles"),
                ("total", "total_revenue_reconciles"),
                ("product", "product_revenue_reconciles"),
                ("freight", "freight_revenue_reconciles"),
            )
            for v in pair
        ]
    )
    counted = F.col("source").isin("orders", "items")
    tolerance = F.when(counted, F.lit(0.0)).otherwise(F.lit(Q.REVENUE_TOLERANCE))
    gap = F.abs(F.col("observed") - F.col("expected"))

    def shown(value: str):
        whole = F.col(value).cast("decimal(38,0)").cast("string")
        return F.when(counted, whole).otherwise(F.col(value).cast("string"))

    return (
        observed.join(source_totals(silver), "source")
        .select(
            "dataset",
            names[F.col("source")].alias("check_name"),
            F.when(gap <= tolerance, "PASS").otherwise("FAIL").alias("status"),
            F.lit("critical").alias("severity"),
            shown("observed").alias("observed_value"),
            shown("expected").alias("expected_value"),
            F.lit("").alias("details"),
        )
    )


def public_column_check(df: DataFrame) -> DataFrame:
    name = "gold_public_sales_dashboard"
    found = forbidden_name_parts(df.columns)
    return Q.metadata_checks(
        df,
        name,
        [
            (
                "no_forbidden_public_columns",
                not found,
                Q.listed(found),
                "none",
                "",
            )
        ],
    )


def gold_row_checks(name: str, df: DataFrame) -> list[Q.Check]:
    public = name == "gold_public_sales_dashboard"
    return [
        Q.not_empty(),
        Q.key_not_null(GOLD_KEYS[name]),
        Q.no_null_cells(df),
        *gold_rule_checks(name),
        *(Q.pii_like_checks(["customer_state", "product_category_name_english"]) if public else []),
    ]


def validate_gold(
    gold: dict[str, DataFrame], silver: dict[str, DataFrame], counters: Counters | None = None
) -> DataFrame:
    """Structure, rules, privacy and source reconciliation of all Gold datasets."""
    return Q.union_all(
        [
            Q.exact_columns_of({n: (gold[n], list(GOLD_COLUMNS[n])) for n in GOLD_KEYS}),
            _row_results(gold, {n: gold_row_checks(n, gold[n]) for n in GOLD_KEYS}, counters),
            Q.unique_rows_and_keys({n: (gold[n], key) for n, key in GOLD_KEYS.items()}),
            public_column_check(gold["gold_public_sales_dashboard"]),
            reconcile_with_source(gold, silver, counters),
        ]
    )


def validate_contracts(gold: dict[str, DataFrame], counters: Counters | None = None) -> DataFrame:
    """Every contract check of all Gold datasets."""
    contracts = {n: gold_contract(n) for n in GOLD_KEYS}
    checks = {n: contract_row_checks(contracts[n], gold[n]) for n in GOLD_KEYS}
    known = set_results(list(contracts.values()), list(GOLD_KEYS), list(gold))
    known += [
        (n, *result)
        for n, contract in contracts.items()
        for result in metadata_results(contract, GOLD_ZONES[n], n, gold[n].columns)
    ]
    return Q.union_all(
        [
            Q.metadata_table(next(iter(gold.values())).sparkSession, known),
            _row_results(gold, checks, counters),
            Q.unique_rows_and_keys(
                {n: (gold[n], key) for n, key in GOLD_KEYS.items()}, whole_rows=False
            ),
        ]
    )


def write_counters(name: str, df: DataFrame) -> list[Q.Check]:
    """What the write of a dataset counts, so that no later check reads it again."""
    if name in SILVER_KEYS:
        return silver_row_checks(name)
    checks = [
        *gold_row_checks(name, df),
        *gold_totals(name),
        *contract_row_checks(gold_contract(name), df),
    ]
    return list({c.name: c for c in checks}.values())
