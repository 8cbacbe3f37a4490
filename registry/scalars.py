"""Scalar expressions (inventory B), each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.inputs import items, raw, silver_table
from registry.oracle import STAMP, clean, num, sql, ts
from tidelake.functions import keys
from tidelake.functions import scalar as S
from tidelake.sources.testdata import table


@query(
    "b1_clean_string",
    sql(f"""select cast(doc_id as varchar) id, {clean('text')} cleaned from documents
    union all select order_id, {clean('order_status')} from b_orders
    union all select order_id, {clean('customer_id')} from b_orders"""),
)
def clean_string(spark, sf_dir):
    orders = raw(spark, sf_dir, "orders")
    documents = table(spark, sf_dir, "documents")
    return (
        documents.select(F.col("doc_id").cast("string").alias("id"), S.clean_string("text").alias("cleaned"))
        .unionAll(orders.select("order_id", S.clean_string("order_status")))
        .unionAll(orders.select("order_id", S.clean_string("customer_id")))
    )


@query(
    "b2_parse_timestamp",
    sql(f"""select order_id, {ts('order_approved_at')} approved,
    {ts('order_delivered_customer_date')} delivered from b_orders"""),
)
def parse_timestamp(spark, sf_dir):
    return raw(spark, sf_dir, "orders").select(
        "order_id",
        S.parse_timestamp("order_approved_at").alias("approved"),
        S.parse_timestamp("order_delivered_customer_date").alias("delivered"),
    )


@query(
    "b3_numeric_coercion",
    sql(f"""select order_id, {num('payment_installments', 'bigint')} installments,
    {num('payment_value', 'double')} amount from b_order_payments"""),
)
def numeric_coercion(spark, sf_dir):
    return raw(spark, sf_dir, "order_payments").select(
        "order_id",
        S.to_number("payment_installments", "bigint").alias("installments"),
        S.to_number("payment_value", "double").alias("amount"),
    )


@query(
    "b4_case_normalisation",
    sql(f"""select customer_id, lower({clean('customer_city')}) city,
    upper({clean('customer_state')}) state from b_customers"""),
)
def case_normalisation(spark, sf_dir):
    return raw(spark, sf_dir, "customers").select(
        "customer_id",
        F.lower(S.clean_string("customer_city")).alias("city"),
        F.upper(S.clean_string("customer_state")).alias("state"),
    )


_SPELLINGS = (
    "case event_id % 8 when 0 then ' TRUE' when 1 then 'yes' when 2 then '1' when 3 then 'False'"
    " when 4 then 'NO ' when 5 then '0' when 6 then 't' else '' end"
)


@query(
    "b5_consent",
    sql(f"""select spelling, case when s in ('true','yes','1') then true
      when s in ('false','no','0') then false end consent, count(*) n,
      count(*) filter (s is null or s not in ('true','yes','1','false','no','0')) invalid
    from (select spelling, lower({clean('spelling')}) s
      from (select {_SPELLINGS} spelling from events)) group by 1, 2"""),
)
def consent(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.expr(_SPELLINGS).alias("spelling"))
    return events.groupBy("spelling", S.consent("spelling").alias("consent")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(S.consent("spelling").isNull()).alias("invalid"),
    )


@query(
    "b6_fractional_days",
    sql("""select order_id, delivery_delay_days, actual_delivery_days from s_orders"""),
)
def fractional_days(spark, sf_dir):
    raw_orders = raw(spark, sf_dir, "orders")
    bought, due, received = (
        S.parse_timestamp(c)
        for c in (
            "order_purchase_timestamp",
            "order_estimated_delivery_date",
            "order_delivered_customer_date",
        )
    )
    return raw_orders.select(
        "order_id",
        S.fractional_days_between(due, received).alias("delivery_delay_days"),
        S.fractional_days_between(bought, received).alias("actual_delivery_days"),
    )


@query(
    "b7_date_and_text",
    f"""select event_id, cast(ts as date) event_date, strftime(ts, {STAMP}) || '+00:00' utc_text
    from events""",
)
def date_and_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.to_date("ts").alias("event_date"), S.utc_text("ts").alias("utc_text")
    )


@query(
    "b8_item_total",
    sql(f"""select order_id, order_item_id, {num('price', 'double')} +
    {num('freight_value', 'double')} item_total_value from b_order_items"""),
)
def item_total(spark, sf_dir):
    total = S.to_number("price", "double") + S.to_number("freight_value", "double")
    return raw(spark, sf_dir, "order_items").select(
        "order_id", "order_item_id", total.alias("item_total_value")
    )


@query(
    "b9_column_rename",
    sql("""select product_id, product_name_lenght product_name_length,
    product_description_lenght product_description_length from b_products"""),
)
def column_rename(spark, sf_dir):
    from tidelake.plans.silver import PRODUCT_RENAMES

    renamed = raw(spark, sf_dir, "products").withColumnsRenamed(PRODUCT_RENAMES)
    return renamed.select("product_id", *PRODUCT_RENAMES.values())


@query(
    "b10_null_fill",
    sql("""select p.product_id, coalesce(t.product_category_name_english, 'unknown') category,
      coalesce(p.product_photos_qty, 0.0) photos
    from s_products p left join s_categories t
      on t.product_category_name = lower(p.product_category_name)"""),
)
def null_fill(spark, sf_dir):
    products = silver_table(spark, sf_dir, "silver_products").withColumn(
        "product_category_name", F.lower("product_category_name")
    )
    categories = silver_table(spark, sf_dir, "silver_product_categories")
    return products.join(categories, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name_english", F.lit("unknown")).alias("category"),
        F.coalesce("product_photos_qty", F.lit(0.0)).alias("photos"),
    )


@query(
    "b11_safe_ratio",
    """select l_orderkey, l_linenumber, l_extendedprice,
    coalesce(l_extendedprice / nullif(l_linenumber - 1, 0), 0) per_line from lineitem""",
)
def safe_ratio(spark, sf_dir):
    ratio = S.safe_ratio(F.col("l_extendedprice"), (F.col("l_linenumber") - 1).cast("double"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", ratio.alias("per_line")
    )


@query(
    "b12_round_numeric",
    """select o_orderkey, cast(round(cast(o_totalprice as decimal(38,10)), 1) as double) o_totalprice
    from orders""",
)
def round_numeric(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.round_numeric(orders, {"o_totalprice": 1})


@query(
    "b13_record_key",
    sql(f"""select order_id, order_item_id, sha256(coalesce(order_id,'') || '|' ||
      coalesce({clean('product_id')},'') || '|' || coalesce({num('order_item_id','bigint')}::varchar,''))
      record_key from b_order_items"""),
)
def record_key(spark, sf_dir):
    return raw(spark, sf_dir, "order_items").select(
        "order_id",
        "order_item_id",
        keys.record_key(
            "order_id", S.clean_string("product_id"), S.to_number("order_item_id", "bigint")
        ).alias("record_key"),
    )


@query(
    "b14_pseudonyms",
    sql("""select customer_id, synthetic_email, synthetic_phone, marketing_consent from b_contact"""),
)
def pseudonyms(spark, sf_dir):
    return raw(spark, sf_dir, "customer_contact").drop("pii_classification")


@query(
    "b14_pseudonym_collisions",
    sql("""select count(*) total_rows, count(distinct customer_id) customers,
      count(distinct synthetic_email) emails, count(distinct synthetic_phone) phones,
      count(*) - count(distinct synthetic_email) email_collisions,
      count(*) - count(distinct synthetic_phone) phone_collisions from b_contact"""),
)
def pseudonym_collisions(spark, sf_dir):
    contact = raw(spark, sf_dir, "customer_contact")
    emails, phones = F.count_distinct("synthetic_email"), F.count_distinct("synthetic_phone")
    rows = F.count(F.lit(1))
    return contact.agg(
        rows.alias("total_rows"),
        F.count_distinct("customer_id").alias("customers"),
        emails.alias("emails"),
        phones.alias("phones"),
        (rows - emails).alias("email_collisions"),
        (rows - phones).alias("phone_collisions"),
    )


@query(
    "b15_regex_predicates",
    r"""select doc_id,
      regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') email_like,
      regexp_matches(upper(lang), '^(?:[A-Z]{2}|UNKNOWN)$') state_like,
      regexp_matches(source, 'src1') source_like
    from documents""",
)
def regex_predicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        keys.looks_like_email("text").alias("email_like"),
        keys.is_state_code(F.upper("lang")).alias("state_like"),
        F.regexp_like("source", F.lit("src1")).alias("source_like"),
    )


@query(
    "b15_phone_like",
    r"""select doc_id,
      regexp_matches(text, '\p{Nd}(?:[\s\p{Z}\x0B\x{1C}-\x{1F}\x{85}().-]*\+?\p{Nd}){7}') phone_like from documents""",
)
def phone_like(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", keys.looks_like_phone("text").alias("phone_like")
    )


@query(
    "b16_composite_key",
    sql(f"""select order_id, {clean('order_status')} || '|' || order_id || '|' ||
    {clean('customer_id')} composite_key from b_orders"""),
)
def composite_key(spark, sf_dir):
    return raw(spark, sf_dir, "orders").select(
        "order_id",
        keys.composite_key(
            S.clean_string("order_status"), "order_id", S.clean_string("customer_id")
        ).alias("composite_key"),
    )


@query(
    "b17_array_functions",
    """select vec_id, cast(len(v) as int) positives,
      case when len(v) = 0 then null when len(v) % 2 = 1 then v[(len(v) + 1) // 2]
        else (v[len(v) // 2] + v[len(v) // 2 + 1]) / 2 end middle
    from (select vec_id, list_sort(list_filter([cast(x as double) for x in embedding],
      lambda x: x is not null and x > 0)) v from embeddings)""",
)
def array_functions(spark, sf_dir):
    """Middle of the positive components of each vector."""
    values = F.array_sort(
        F.filter(
            F.transform("embedding", lambda x: x.cast("double")),
            lambda x: x.isNotNull() & (x > 0),
        )
    )
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", values.alias("v"))
    size, half = F.size("v"), F.floor(F.size("v") / 2).cast("int")
    middle = (
        F.when(size == 0, F.lit(None).cast("double"))
        .when(size % 2 == 1, F.try_element_at("v", half + 1))
        .otherwise((F.try_element_at("v", F.greatest(half, F.lit(1))) + F.try_element_at("v", half + 1)) / 2)
    )
    return vectors.select("vec_id", size.alias("positives"), middle.alias("middle"))


@query(
    "b18_row_predicates",
    sql("""select order_id, order_status,
      case when delivery_delay_days between -10 and 0 then 'early'
        when delivery_delay_days > 0 then 'late' else 'other' end punctuality
    from s_orders where lower(order_status) = 'delivered'
      and order_delivered_customer_date is not null and abs(delivery_delay_days) > 0.5
      and order_status not in ('shipped', 'canceled')"""),
)
def row_predicates(spark, sf_dir):
    delay = F.col("delivery_delay_days")
    orders = silver_table(spark, sf_dir, "silver_orders").where(
        (F.lower("order_status") == "delivered")
        & F.col("order_delivered_customer_date").isNotNull()
        & (F.abs(delay) > 0.5)
        & ~F.col("order_status").isin("shipped", "canceled")
    )
    punctuality = F.when(delay.between(-10, 0), "early").when(delay > 0, "late").otherwise("other")
    return orders.select("order_id", "order_status", punctuality.alias("punctuality"))


@query(
    "b19_identifier",
    """select page_id, nullif(trim(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '-'), '')
    identifier from pages""",
)
def identifier(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.identifier("url").alias("identifier"))


_ISO_SPARK = (
    "case event_id % 3 when 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    " when 1 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\") else 'n/a' end"
)


@query(
    "b20_iso_timestamp",
    """select event_id, case event_id % 3 when 0 then date_trunc('second', ts)
      when 1 then date_trunc('second', ts) - interval 2 hour end at_utc from events""",
)
def iso_timestamp(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr(_ISO_SPARK).alias("text"))
    return events.select("event_id", S.parse_iso_utc("text").alias("at_utc"))


@query("b18_enriched_unknowns", sql("""select product_category_name_english, count(*) n
    from items where product_category_name_english = 'unknown' group by 1"""))
def enriched_unknowns(spark, sf_dir):
    return (
        items(spark, sf_dir)
        .where("product_category_name_english = 'unknown'")
        .groupBy("product_category_name_english")
        .agg(F.count(F.lit(1)).alias("n"))
    )
