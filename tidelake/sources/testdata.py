"""Raw tables derived from the TPC-H-like Parquet tables.

Each raw table is a projection (plus dimension look-ups) of the given tables, as text,
with padding, blanks, unreadable numbers and repeated rows so that the cleaning steps
have something to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import keys


# Schemas of the given tables, so that no job is spent on reading footers.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
        " props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _texts(df: DataFrame, **exprs: str) -> DataFrame:
    return df.select(*[F.expr(e).cast("string").alias(n) for n, e in exprs.items()])


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(
        table(spark, sf_dir, "orders"),
        order_id="o_orderkey",
        customer_id="concat(' ', o_custkey, '\t')",
        order_status=(
            "case o_orderstatus when 'F' then ' Delivered ' when 'O' then 'shipped' else '' end"
        ),
        order_purchase_timestamp="o_orderdate",
        order_approved_at=(
            "case when o_orderstatus = 'P' then 'not yet'"
            " else cast(timestampadd(HOUR, o_orderkey % 48, o_orderdate) as string) end"
        ),
        order_delivered_carrier_date=(
            "case when o_orderstatus = 'P' then ' '"
            " else cast(timestampadd(DAY, o_orderkey % 7, o_orderdate) as string) end"
        ),
        order_delivered_customer_date=(
            "case when o_orderstatus = 'F' then cast(timestampadd(MINUTE,"
            " o_orderkey % 65000 + o_custkey % 59, o_orderdate) as string) else '' end"
        ),
        order_estimated_delivery_date="timestampadd(DAY, 30, o_orderdate)",
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        # Made once in a select of its own, not once a mention.
        F.col("l_extendedprice").cast("decimal(12,2)").alias("_amount"),
        "l_tax",
    )
    return _texts(
        lines,
        order_id="l_orderkey",
        order_item_id="l_linenumber",
        product_id="l_partkey",
        seller_id="l_suppkey",
        shipping_limit_date="l_shipdate",
        price=(
            "case when l_linenumber > 1 then cast(_amount as string)"
            " when l_orderkey % 997 = 0 then '1e300' when l_orderkey % 991 = 0"
            " then '12345678901234567.89' when l_orderkey % 983 = 0 then 'free'"
            " when l_orderkey % 977 = 0 then '1e400'"
            " else cast(_amount as string) end"
        ),
        freight_value="round(_amount * cast(l_tax as decimal(4,2)), 2)",
    )


def raw_order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(
        table(spark, sf_dir, "orders"),
        order_id="o_orderkey",
        payment_sequential="1",
        payment_type="concat(o_orderpriority, '\n')",
        payment_installments=(
            "case when o_orderkey % 97 = 0 then 'n/a' else cast(o_orderkey % 12 + 1 as string) end"
        ),
        payment_value="cast(o_totalprice as decimal(12,2))",
    )


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    places = _nations(spark, sf_dir)
    return _texts(
        customer.join(places, customer.c_nationkey == places.n_nationkey),
        customer_id="c_custkey",
        customer_unique_id="c_custkey div 2",
        customer_zip_code_prefix="c_nationkey",
        customer_city="concat(r_name, ' ')",
        customer_state="lower(n_name)",
    )


def raw_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    places = _nations(spark, sf_dir)
    return _texts(
        supplier.join(places, supplier.s_nationkey == places.n_nationkey),
        seller_id="s_suppkey",
        seller_zip_code_prefix="s_nationkey",
        seller_city="concat(' ', r_name)",
        seller_state="lower(n_name)",
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(
        table(spark, sf_dir, "part"),
        product_id="p_partkey",
        product_category_name="case when p_partkey % 53 = 0 then ' ' else p_type end",
        product_name_lenght="length(p_name)",
        product_description_lenght="length(p_name) * 12",
        product_photos_qty="case when p_size % 19 = 0 then '' else cast(p_size % 6 as string) end",
        product_weight_g="p_size * 100",
        product_length_cm="p_size + 5",
        product_height_cm="p_size % 9 + 1",
        product_width_cm="p_size % 13 + 2",
    )


def raw_category_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_type <> 'SMALL'")
    return _texts(
        parts.select("p_type").distinct(),
        product_category_name="p_type",
        product_category_name_english="concat(' Goods ', p_type)",
    )


def raw_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(
        table(spark, sf_dir, "events"),
        geolocation_zip_code_prefix=(
            "case when event_id % 211 = 0 then 'none' else cast(user_id as string) end"
        ),
        geolocation_lat=(
            "case when event_id % 401 = 0 then '1d' when event_id % 409 = 0 then 'NaN'"
            " when event_id % 419 = 0 then '0x1p3' when event_id % 421 = 0 then 'Infinity'"
            " when event_id % 431 = 0 then '1e400' else cast(cast(value as decimal(12,2)) as string) end"
        ),
        geolocation_lng="event_id % 360 - 180",
        geolocation_city=(
            "case when event_id % 3 = 0 then upper(event_type) else event_type end"
        ),
        geolocation_state="case when event_id % 50 = 0 then '' else concat('s', event_id % 7) end",
    )


def raw_order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per conversation; its turns are the repeated records of that review."""
    return _texts(
        table(spark, sf_dir, "conversations"),
        review_id="conv_id",
        order_id="conv_id * 3",
        review_score="case when turn = 5 then 'x' else cast(length(text) % 6 as string) end",
        review_comment_title="case when role = 'system' then '' else role end",
        review_comment_message="text",
        review_creation_date=(
            "timestampadd(DAY, cast(conv_id % 365 as int), timestamp_ntz'2018-01-01 00:00:00')"
        ),
        review_answer_timestamp=(
            "case when conv_id % 9 = 0 then '' when conv_id % 11 = 0 then '10:30:00'"
            " when conv_id % 13 = 0 then '2018-01' else cast(timestampadd(HOUR,"
            " cast(conv_id % 1000 as int), timestamp_ntz'2018-01-02 10:30:00') as string) end"
        ),
    )


def raw_customer_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer_id = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        customer_id.alias("customer_id"),
        keys.pseudonym_email(customer_id).alias("synthetic_email"),
        keys.pseudonym_phone(customer_id).alias("synthetic_phone"),
        keys.pseudonym_consent(customer_id).alias("marketing_consent"),
        F.lit("PII").alias("pii_classification"),
    )


RAW_TABLES = {
    "customers": raw_customers,
    "geolocation": raw_geolocation,
    "order_items": raw_order_items,
    "order_payments": raw_order_payments,
    "order_reviews": raw_order_reviews,
    "orders": raw_orders,
    "products": raw_products,
    "sellers": raw_sellers,
    "product_category_name_translation": raw_category_translation,
    "customer_contact": raw_customer_contact,
}

# Raw table -> the given table with its records.
RAW_SOURCES = {
    "customers": "customer",
    "geolocation": "events",
    "order_items": "lineitem",
    "order_payments": "orders",
    "order_reviews": "conversations",
    "orders": "orders",
    "products": "part",
    "sellers": "supplier",
    "product_category_name_translation": "part",
    "customer_contact": "customer",
}


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: build(spark, sf_dir) for name, build in RAW_TABLES.items()}


# ---- evidence ----------------------------------------------------------------------

SCENARIO_OF_EVENT = (
    "case event_type when 'click' then 'schema_break' when 'view' then 'pii_exposure'"
    " when 'purchase' then 'freshness_breach' when 'error' then 'quality_regression'"
    " else 'policy_false_positive' end"
)


def _list_if(condition: str, *values: str) -> str:
    """SQL array of ``values`` where the condition holds, else the empty array."""
    items = ", ".join(f"'{v}'" for v in values)
    return f"if({condition}, array({items}), cast(array() as array<string>))"


def policy_inputs(spark: SparkSession, sf_dir: str, recovered: bool = False) -> DataFrame:
    """One policy input per event, in the fixed evidence structure.

    ``recovered`` gives the evidence after remediation: the faults of four runs in five
    are gone, and it is recorded some time after the first.
    """
    still = "event_id % 5 = 0" if recovered else "true"

    def fault(condition: str) -> str:
        return f"(({condition}) and {still})"

    leaked = fault("event_type = 'view' and event_id % 4 < 3")
    dropped, added = fault("event_id % 13 = 0"), fault("event_id % 43 = 0")
    age = "cast(cast(value as decimal(12,2)) * 1000 as double)"
    first_age = f"if({still}, {age}, 0.0D)"
    second_age = f"if({still}, cast(event_id * 37 % 100000 as double), 0.0D)"
    first_status = f"if({fault('event_id % 53 = 0')}, 'FAIL', 'PASS')"
    breached = f"({first_age} > 172800 or {second_age} > 86400 or {first_status} = 'FAIL')"
    bad_quality = fault("event_type = 'error' and value > 40")
    sections = {
        "schema_version": "'1.0.0'",
        "evaluation_stage": "if(event_id % 2 = 0, 'pre', 'post')",
        "experiment": (
            f"named_struct('condition', 'C2', 'scenario_id', {SCENARIO_OF_EVENT}, 'run_key',"
            " if(event_id % 101 = 0, '', concat('run-', event_id)))"
        ),
        "controls": (
            "named_struct('policy_as_code_required', true, 'self_healing_permitted', true,"
            " 'automatic_remediation_permitted', event_type <> 'signup')"
        ),
        "git": (
            f"named_struct('branch', case when {fault('event_id % 17 = 0')} then ''"
            f" when {fault('event_id % 19 = 0')} then null else 'main' end,"
            f" 'commit', if({fault('event_id % 23 = 0')}, '', concat('c', event_id)))"
        ),
        "release": (
            "named_struct('target_layer', 'gold', 'promotion_requested', event_id % 3 <> 0)"
        ),
        "metadata": (
            f"named_struct('required_fields_present', case when {fault('event_id % 29 = 0')}"
            " then false when event_id % 31 = 0 then null else true end, 'resource_count',"
            f" case when {fault('event_id % 37 = 0')} then 0L when event_id % 41 = 0 then null"
            " else 15L end)"
        ),
        "schema_contract": (
            "named_struct('governed_models', array("
            "named_struct('model', 'gold_customer_order_summary', 'exposure', 'internal',"
            f" 'expected_column_count', 11L, 'actual_column_count', 11L - int({dropped})"
            f" + int({added}), 'missing_columns', {_list_if(dropped, 'average_order_value')},"
            f" 'unexpected_columns', {_list_if(added, 'loyalty_tier')},"
            " 'incompatible_type_changes',"
            f" {_list_if(fault('event_id % 47 = 0'), 'total_orders: integer to string')}),"
            " named_struct('model', 'gold_public_sales_dashboard', 'exposure', 'public',"
            f" 'expected_column_count', 8L, 'actual_column_count', 8L + int({leaked}),"
            " 'missing_columns', cast(array() as array<string>),"
            f" 'unexpected_columns', {_list_if(leaked, 'synthetic_email', 'synthetic_phone')},"
            " 'incompatible_type_changes', cast(array() as array<string>))))"
        ),
        "transformation": (
            f"named_struct('changed_models', {_list_if('event_id % 11 = 0', 'gold_daily_sales')},"
            f" 'unapproved_definitions', {_list_if(fault('event_id % 33 = 0'), 'gold_shadow')},"
            " 'manifest_sha256', sha2(concat('m', event_id), 256))"
        ),
        "privacy": (
            "named_struct('public_models', array('gold_public_sales_dashboard'),"
            " 'forbidden_columns', array('synthetic_email', 'synthetic_phone'),"
            " 'detected_forbidden_columns',"
            f" {_list_if(leaked, 'synthetic_email', 'synthetic_phone')})"
        ),
        "quality": (
            f"named_struct('status', if({bad_quality}, 'FAIL', 'PASS'), 'total_tests', 41L,"
            f" 'failed_tests', if({bad_quality}, event_id % 4 + 1, 0L), 'critical_failures',"
            f" {_list_if(bad_quality, 'test.keys', 'test.revenue')})"
        ),
        "freshness": (
            f"named_struct('status', if({breached} or {fault('event_id % 59 = 0')}, 'FAIL',"
            " 'PASS'), 'sources', array("
            f"named_struct('source', 'gold_daily_sales', 'observed_age_seconds', {first_age},"
            f" 'maximum_age_seconds', 172800.0D, 'status', {first_status}),"
            f" named_struct('source', 'silver_orders', 'observed_age_seconds', {second_age},"
            " 'maximum_age_seconds', 86400.0D, 'status', 'PASS')))"
        ),
        "runtime": (
            f"named_struct('pipeline_status', case when {fault('event_id % 61 = 0')} then 'FAIL'"
            " when event_id % 79 = 0 then null else 'PASS' end, 'canonical_unchanged',"
            f" not {fault('event_id % 67 = 0')}, 'isolated_output_tables',"
            f" if({fault('event_id % 71 = 0')}, 14L, 15L), 'athena_failed_queries',"
            f" if({fault('event_id % 73 = 0')}, 2L, 0L))"
        ),
    }
    delay = "event_id % 900 + 30" if recovered else "0"
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return events.select(
        *[F.expr(e).alias(n) for n, e in sections.items()],
        F.expr(f"timestampadd(SECOND, {delay}, ts)").cast("timestamp").alias("recorded_at"),
    )
