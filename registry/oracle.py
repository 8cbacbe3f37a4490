"""SQL fragments shared by the oracle texts: raw look-alikes, Silver and Gold in DuckDB."""

from __future__ import annotations

import re

from tidelake.plans import rules, silver
from tidelake.sources.schemas import RAW_COLUMNS

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
STAMP = "'%Y-%m-%d %H:%M:%S'"


def clean(expr: str) -> str:
    return f"nullif(trim(cast({expr} as varchar), {_BLANKS}), '')"


def ts(expr: str) -> str:
    text = clean(expr)
    full = f"regexp_matches({text}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([ T]|$)')"
    return f"case when {full} then try_cast({text} as timestamp) end"


def num(expr: str, dtype: str) -> str:
    text = clean(expr)
    plain = f"regexp_matches({text}, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')"
    value = f"try_cast({text} as {dtype})"
    if dtype == "double":
        plain = f"{plain} and isfinite({value})"
    return f"case when {plain} then {value} end"


def rejection(expr: str, kind: str) -> str:
    """Why a raw cell is lost as ``kind``, or NULL."""
    text = clean(expr)
    if kind == "timestamp":
        return f"case when {text} is not null and {ts(expr)} is null then 'unreadable' end"
    if kind == "consent":
        literals = "('true','yes','1','false','no','0')"
        return f"case when lower({text}) not in {literals} then 'unreadable' end"
    value = num(expr, "double" if kind == "money" else kind)
    plain = f"regexp_matches({text}, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')"
    beyond = f"try_cast({value} as decimal(18,2)) is null"
    money = f" when {beyond} then 'beyond_money'" if kind == "money" else ""
    return (
        f"case when {text} is null then null when not {plain} then 'unreadable'"
        f" when {value} is null then 'does_not_fit'{money} end"
    )


def cents(expr: str) -> str:
    """Whole cents of a money amount."""
    return f"cast(round(({expr}) * 100) as hugeint)"


def money_sum(expr: str) -> str:
    """Sum of the amounts that fit the money type."""
    return f"cast(sum(try_cast({expr} as decimal(18,2))) as double)"


def ratio(top_cents: str, bottom: str) -> str:
    """Half-up quotient in cents, on integers."""
    return (
        f"coalesce(cast((2*({top_cents}) + ({bottom})) // nullif(2*({bottom}),0) as double)/100, 0.0)"
    )


CTES: dict[str, str] = {}

# ---- raw look-alikes -------------------------------------------------------------
CTES["b_orders"] = f"""
select cast(o_orderkey as varchar) order_id,
  ' ' || o_custkey || chr(9) customer_id,
  case o_orderstatus when 'F' then ' Delivered ' when 'O' then 'shipped' else '' end order_status,
  strftime(o_orderdate, {STAMP}) order_purchase_timestamp,
  case when o_orderstatus = 'P' then 'not yet'
    else strftime(o_orderdate + to_hours(o_orderkey % 48), {STAMP}) end order_approved_at,
  case when o_orderstatus = 'P' then ' '
    else strftime(o_orderdate + to_days(cast(o_orderkey % 7 as int)), {STAMP}) end
    order_delivered_carrier_date,
  case when o_orderstatus = 'F'
    then strftime(o_orderdate + to_minutes(o_orderkey % 65000 + o_custkey % 59), {STAMP})
    else '' end order_delivered_customer_date,
  strftime(o_orderdate + to_days(30), {STAMP}) order_estimated_delivery_date
from orders"""
CTES["b_order_items"] = f"""
select cast(l_orderkey as varchar) order_id, cast(l_linenumber as varchar) order_item_id,
  cast(l_partkey as varchar) product_id, cast(l_suppkey as varchar) seller_id,
  strftime(l_shipdate, {STAMP}) shipping_limit_date,
  case when l_linenumber > 1 then cast(cast(l_extendedprice as decimal(12,2)) as varchar)
    when l_orderkey % 997 = 0 then '1e300'
    when l_orderkey % 991 = 0 then '12345678901234567.89'
    when l_orderkey % 983 = 0 then 'free' when l_orderkey % 977 = 0 then '1e400'
    else cast(cast(l_extendedprice as decimal(12,2)) as varchar) end price,
  cast(round(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)), 2) as varchar)
    freight_value
from lineitem"""
CTES["b_order_payments"] = """
select cast(o_orderkey as varchar) order_id, '1' payment_sequential,
  o_orderpriority || chr(10) payment_type,
  case when o_orderkey % 97 = 0 then 'n/a' else cast(o_orderkey % 12 + 1 as varchar) end
    payment_installments,
  cast(cast(o_totalprice as decimal(12,2)) as varchar) payment_value
from orders"""
CTES["b_customers"] = """
select cast(c_custkey as varchar) customer_id, cast(c_custkey // 2 as varchar) customer_unique_id,
  cast(c_nationkey as varchar) customer_zip_code_prefix, r_name || ' ' customer_city,
  lower(n_name) customer_state
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
CTES["b_sellers"] = """
select cast(s_suppkey as varchar) seller_id, cast(s_nationkey as varchar) seller_zip_code_prefix,
  ' ' || r_name seller_city, lower(n_name) seller_state
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
CTES["b_products"] = """
select cast(p_partkey as varchar) product_id,
  case when p_partkey % 53 = 0 then ' ' else p_type end product_category_name,
  cast(length(p_name) as varchar) product_name_lenght,
  cast(length(p_name) * 12 as varchar) product_description_lenght,
  case when p_size % 19 = 0 then '' else cast(p_size % 6 as varchar) end product_photos_qty,
  cast(p_size * 100 as varchar) product_weight_g, cast(p_size + 5 as varchar) product_length_cm,
  cast(p_size % 9 + 1 as varchar) product_height_cm,
  cast(p_size % 13 + 2 as varchar) product_width_cm
from part"""
CTES["b_categories"] = """
select distinct p_type product_category_name, ' Goods ' || p_type product_category_name_english
from part where p_type <> 'SMALL'"""
CTES["b_geolocation"] = """
select case when event_id % 211 = 0 then 'none' else cast(user_id as varchar) end
    geolocation_zip_code_prefix,
  case when event_id % 401 = 0 then '1d' when event_id % 409 = 0 then 'NaN'
    when event_id % 419 = 0 then '0x1p3' when event_id % 421 = 0 then 'Infinity'
    when event_id % 431 = 0 then '1e400' else cast(cast(value as decimal(12,2)) as varchar) end
    geolocation_lat,
  cast(event_id % 360 - 180 as varchar) geolocation_lng,
  case when event_id % 3 = 0 then upper(event_type) else event_type end geolocation_city,
  case when event_id % 50 = 0 then '' else 's' || (event_id % 7) end geolocation_state
from events"""
CTES["b_reviews"] = f"""
select cast(conv_id as varchar) review_id, cast(conv_id * 3 as varchar) order_id,
  case when turn = 5 then 'x' else cast(length(text) % 6 as varchar) end review_score,
  case when role = 'system' then '' else role end review_comment_title,
  text review_comment_message,
  strftime(timestamp '2018-01-01 00:00:00' + to_days(cast(conv_id % 365 as int)), {STAMP})
    review_creation_date,
  case when conv_id % 9 = 0 then '' when conv_id % 11 = 0 then '10:30:00'
    when conv_id % 13 = 0 then '2018-01'
    else strftime(timestamp '2018-01-02 10:30:00' + to_hours(conv_id % 1000), {STAMP}) end
    review_answer_timestamp
from conversations"""


def _token(purpose: str) -> str:
    return f"sha256('synthetic-customer-contact-v1|{purpose}|' || c_custkey)"


def _leading(purpose: str) -> str:
    return f"cast(('0x' || substr({_token(purpose)}, 1, 16)) as uint64)"


CTES["b_contact"] = f"""
select cast(c_custkey as varchar) customer_id,
  substr({_token('email')}, 1, 24) || '@synthetic-example.com' synthetic_email,
  '+3538' || lpad(cast({_leading('phone')} % 10000000000 as varchar), 10, '0') synthetic_phone,
  {_leading('marketing-consent')} % 10000 < 7500 marketing_consent,
  'PII' pii_classification
from customer"""

# ---- Silver ------------------------------------------------------------------------
CTES["s_orders"] = f"""
select *, cast(order_purchase_timestamp as date) order_purchase_date,
  cast(epoch(order_delivered_customer_date) - epoch(order_estimated_delivery_date) as double)
    / 86400 delivery_delay_days,
  cast(epoch(order_delivered_customer_date) - epoch(order_purchase_timestamp) as double)
    / 86400 actual_delivery_days
from (select distinct {clean('order_id')} order_id, {clean('customer_id')} customer_id,
  {clean('order_status')} order_status, {ts('order_purchase_timestamp')} order_purchase_timestamp,
  {ts('order_approved_at')} order_approved_at,
  {ts('order_delivered_carrier_date')} order_delivered_carrier_date,
  {ts('order_delivered_customer_date')} order_delivered_customer_date,
  {ts('order_estimated_delivery_date')} order_estimated_delivery_date from b_orders)"""
CTES["s_order_items"] = f"""
select *, price + freight_value item_total_value
from (select distinct {clean('order_id')} order_id, {num('order_item_id', 'bigint')} order_item_id,
  {clean('product_id')} product_id, {clean('seller_id')} seller_id,
  {ts('shipping_limit_date')} shipping_limit_date, {num('price', 'double')} price,
  {num('freight_value', 'double')} freight_value from b_order_items)"""
CTES["s_payments"] = f"""
select distinct {clean('order_id')} order_id, {num('payment_sequential', 'bigint')} payment_sequential,
  {clean('payment_type')} payment_type,
  {num('payment_installments', 'bigint')} payment_installments,
  {num('payment_value', 'double')} payment_value from b_order_payments"""
CTES["s_customers"] = f"""
select customer_id, customer_unique_id, customer_zip_code_prefix,
  lower(customer_city) customer_city, upper(customer_state) customer_state
from (select distinct {clean('customer_id')} customer_id,
  {clean('customer_unique_id')} customer_unique_id,
  {num('customer_zip_code_prefix', 'bigint')} customer_zip_code_prefix,
  {clean('customer_city')} customer_city, {clean('customer_state')} customer_state
  from b_customers)"""
CTES["s_sellers"] = f"""
select seller_id, seller_zip_code_prefix, lower(seller_city) seller_city,
  upper(seller_state) seller_state
from (select distinct {clean('seller_id')} seller_id,
  {num('seller_zip_code_prefix', 'bigint')} seller_zip_code_prefix,
  {clean('seller_city')} seller_city, {clean('seller_state')} seller_state from b_sellers)"""
CTES["s_contact"] = f"""
select customer_id, lower(synthetic_email) synthetic_email, synthetic_phone, marketing_consent,
  pii_classification
from (select distinct {clean('customer_id')} customer_id, {clean('synthetic_email')} synthetic_email,
  {clean('synthetic_phone')} synthetic_phone,
  case when lower({clean('marketing_consent')}) in ('true','yes','1') then true
    when lower({clean('marketing_consent')}) in ('false','no','0') then false end marketing_consent,
  {clean('pii_classification')} pii_classification from b_contact)"""
_MEASURES = {
    "product_name_lenght": "product_name_length",
    "product_description_lenght": "product_description_length",
    "product_photos_qty": "product_photos_qty",
    "product_weight_g": "product_weight_g",
    "product_length_cm": "product_length_cm",
    "product_height_cm": "product_height_cm",
    "product_width_cm": "product_width_cm",
}
CTES["s_products"] = f"""
select distinct {clean('product_id')} product_id,
  {clean('product_category_name')} product_category_name,
  {', '.join(f"{num(a, 'double')} {b}" for a, b in _MEASURES.items())} from b_products"""
CTES["s_categories"] = f"""
select lower(product_category_name) product_category_name,
  lower(product_category_name_english) product_category_name_english
from (select distinct {clean('product_category_name')} product_category_name,
  {clean('product_category_name_english')} product_category_name_english from b_categories)"""
CTES["geo_records"] = f"""
select zip, lat, lng, lower(city) city, upper(state) state
from (select distinct {num('geolocation_zip_code_prefix', 'bigint')} zip,
  {num('geolocation_lat', 'double')} lat, {num('geolocation_lng', 'double')} lng,
  {clean('geolocation_city')} city, {clean('geolocation_state')} state from b_geolocation)
where zip is not null"""


def _top(column: str) -> str:
    return f"""(select zip, {column} from (select zip, {column}, row_number() over
      (partition by zip order by count(*) desc, {column}) r from geo_records
      where {column} is not null group by zip, {column}) where r = 1)"""


CTES["s_geolocation"] = f"""
select g.zip geolocation_zip_code_prefix, round(g.lat, 10) geolocation_lat,
  round(g.lng, 10) geolocation_lng, c.city geolocation_city, s.state geolocation_state,
  g.n source_location_records
from (select zip, median(lat) lat, median(lng) lng, count(*) n from geo_records group by zip) g
left join {_top('city')} c on c.zip = g.zip left join {_top('state')} s on s.zip = g.zip"""
CTES["s_reviews"] = f"""
select sha256(coalesce(review_id,'') || '|' || coalesce(order_id,'') || '|'
    || coalesce(strftime(review_creation_date, {STAMP}) || '+00:00','') || '|'
    || coalesce(strftime(review_answer_timestamp, {STAMP}) || '+00:00','') || '|'
    || review_occurrence) review_record_id, *
from (select *, row_number() over (
    partition by review_id, order_id, review_creation_date, review_answer_timestamp
    order by coalesce(review_comment_title,''), coalesce(review_comment_message,''),
      coalesce(review_score,-1)) review_occurrence
  from (select distinct {clean('review_id')} review_id, {clean('order_id')} order_id,
    {num('review_score', 'bigint')} review_score, {clean('review_comment_title')} review_comment_title,
    {clean('review_comment_message')} review_comment_message,
    {ts('review_creation_date')} review_creation_date,
    {ts('review_answer_timestamp')} review_answer_timestamp from b_reviews))"""

# ---- Gold --------------------------------------------------------------------------
CTES["items"] = """
select i.order_id, i.order_item_id, i.product_id, i.seller_id, o.customer_id, c.customer_unique_id,
  coalesce(c.customer_state, 'UNKNOWN') customer_state,
  cast(o.order_purchase_timestamp as date) order_date,
  coalesce(t.product_category_name_english, 'unknown') product_category_name_english,
  coalesce(i.price, 0.0) price, coalesce(i.freight_value, 0.0) freight_value,
  coalesce(i.item_total_value, 0.0) item_total_value
from s_order_items i
join s_orders o on o.order_id = i.order_id and lower(o.order_status) = 'delivered'
  and o.order_purchase_timestamp is not null
left join s_customers c on c.customer_id = o.customer_id
left join s_products p on p.product_id = i.product_id
left join s_categories t on t.product_category_name = lower(p.product_category_name)"""
CTES["financials"] = f"""
select order_id, customer_id, customer_unique_id, customer_state, order_date,
  count(order_item_id) total_items, count(distinct product_id) distinct_products,
  {money_sum('price')} product_revenue, {money_sum('freight_value')} freight_revenue,
  {money_sum('item_total_value')} total_revenue
from items group by all"""


def _sales(key: str, extra: str) -> str:
    return f"""
select *, {extra} from (select {key}, count(distinct order_id) total_orders,
  count(distinct customer_unique_id) unique_customers, cast(sum(total_items) as bigint) units_sold,
  {money_sum('product_revenue')} product_revenue, {money_sum('freight_revenue')} freight_revenue,
  {money_sum('total_revenue')} total_revenue from financials group by {key})"""


_AOV = f"{ratio(cents('total_revenue'), 'total_orders')} average_order_value"
CTES["g_daily"] = _sales(
    "order_date", f"{_AOV}, {ratio(cents('freight_revenue'), 'total_orders')} average_freight_value"
)
CTES["g_state"] = _sales("customer_state", _AOV)
_ITEM_SUMS = f"""{money_sum('price')} product_revenue, {money_sum('freight_value')} freight_revenue,
  {money_sum('item_total_value')}"""
CTES["g_category"] = f"""
select product_category_name_english, total_orders, unique_customers, units_sold, product_revenue,
  freight_revenue, total_revenue, {ratio(cents('product_revenue'), 'units_sold')} average_item_price,
  cast((2*{cents('total_revenue')}*10000 + t) // (2*t) as double)/100 revenue_share_pct
from (select product_category_name_english, count(distinct order_id) total_orders,
  count(distinct customer_unique_id) unique_customers, count(order_item_id) units_sold,
  {_ITEM_SUMS} total_revenue from items group by 1),
 (select {cents('sum(try_cast(item_total_value as decimal(18,2)))')} t from items)"""
CTES["g_customer"] = f"""
select t.customer_unique_id, coalesce(s.customer_state, 'UNKNOWN') customer_state,
  first_order_date, latest_order_date, total_orders, total_items, distinct_products,
  product_revenue, freight_revenue, total_spend,
  {ratio(cents('total_spend'), 'total_orders')} average_order_value
from (select customer_unique_id, min(order_date) first_order_date, max(order_date) latest_order_date,
  count(distinct order_id) total_orders, count(order_item_id) total_items,
  count(distinct product_id) distinct_products, {_ITEM_SUMS} total_spend from items group by 1) t
left join (select customer_unique_id, customer_state, row_number() over (
    partition by customer_unique_id order by count(*) desc, customer_state) r
  from items group by 1, 2) s on s.customer_unique_id = t.customer_unique_id and s.r = 1"""
CTES["g_public"] = f"""
select order_date, customer_state, product_category_name_english,
  count(distinct order_id) total_orders, count(order_item_id) units_sold,
  {_ITEM_SUMS} total_revenue from items group by 1, 2, 3"""


def sql(body: str) -> str:
    """``body`` preceded by the fragments it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} as ({CTES[name].strip()})" for name in needed)
    return f"with {parts}\n{body.strip()}"


# ---- portable content digest -------------------------------------------------------

_KIND = {"timestamp": "timestamp", "consent": "boolean", "bigint": "bigint", "double": "double",
         "money": "double"}


def _silver_columns() -> dict[str, list[tuple[str, str]]]:
    """Columns of the Silver datasets in order, with their kinds."""
    result = {}
    for name, (source, _) in silver.SILVER.items():
        names = [silver.PRODUCT_RENAMES.get(c, c) for c in RAW_COLUMNS[source]]
        kinds = silver.KINDS[name]
        result[name] = [(c, _KIND[kinds[c]] if c in kinds else "string") for c in names]
    result["silver_orders"] += [
        ("order_purchase_date", "date"),
        ("delivery_delay_days", "double"),
        ("actual_delivery_days", "double"),
    ]
    result["silver_order_items"].append(("item_total_value", "double"))
    result["silver_geolocation"].append(("source_location_records", "bigint"))
    result["silver_reviews"].insert(0, ("review_record_id", "string"))
    result["silver_reviews"].append(("review_occurrence", "bigint"))
    return result


COLUMNS = _silver_columns()
_GOLD_KIND = {"integer": "bigint", "decimal": "double"}
for _name, _columns in rules.GOLD_COLUMNS.items():
    COLUMNS[_name] = [(c, _GOLD_KIND.get(k, k)) for c, k in _columns.items()]


def exact_double(c: str) -> str:
    near = f"floor(log2(abs({c})))"
    low = f"({near} - case when pow(2.0, {near}) > abs({c}) then 1 else 0 end)"
    power = f"({low} + case when pow(2.0, {low} + 1) <= abs({c}) then 1 else 0 end)"
    mantissa = f"cast(abs({c}) / pow(2.0, {power}) * {2**52}::double as bigint)"
    return (
        f"case when isnan({c}) then 'nan' when isinf({c}) then case when {c} < 0 then '-inf'"
        f" else 'inf' end when {c} = 0 then '0' else case when {c} < 0 then '-' else '' end"
        f" || {mantissa} || 'p' || cast({power} as bigint) end"
    )


def cell_text(c: str, kind: str) -> str:
    texts = {
        "double": exact_double(c),
        "timestamp": f"cast(epoch_us({c}) as varchar)",
        "date": f"cast({c} - date '1970-01-01' as varchar)",
        "string": c,
    }
    return texts.get(kind, f"cast({c} as varchar)")


def digest_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """One row: row_count, column_count, content_sha256."""
    cells = []
    for c, kind in columns:
        text = cell_text(c, kind)
        cells.append(f"coalesce(strlen({text}) || ':' || {text}, '-')")
    sums = " || '|' || ".join(
        f"coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::bigint), 0)" for i in range(8)
    )
    names = ",".join(c for c, _ in columns)
    return (
        f"select count(*) row_count, {len(columns)}::bigint column_count,"
        f" sha256('{names}|' || count(*) || '|' || {sums}) content_sha256"
        f" from (select sha256({' || '.join(cells)}) h from {source})"
    )


def manifest_sql(sources: dict[str, str]) -> str:
    """Digest rows of datasets, each read from its fragment."""
    return " union all ".join(
        f"select '{n}' dataset, * from ({digest_sql(source, COLUMNS[n])})"
        for n, source in sources.items()
    )


SILVER_SOURCES = {
    "silver_orders": "s_orders",
    "silver_order_items": "s_order_items",
    "silver_payments": "s_payments",
    "silver_customers": "s_customers",
    "silver_customer_contact": "s_contact",
    "silver_products": "s_products",
    "silver_product_categories": "s_categories",
    "silver_geolocation": "s_geolocation",
    "silver_reviews": "s_reviews",
    "silver_sellers": "s_sellers",
}
GOLD_SOURCES = {
    "gold_daily_sales": "g_daily",
    "gold_sales_by_state": "g_state",
    "gold_product_category_revenue": "g_category",
    "gold_customer_order_summary": "g_customer",
    "gold_public_sales_dashboard": "g_public",
}
