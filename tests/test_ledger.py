"""The ledger of lost cells: every reason, every dataset, and amounts that no sum can hold."""

import pytest
from pyspark.sql import functions as F

from tidelake.functions import scalar as S
from tidelake.operators import contracts, rejects
from tidelake.plans import gold, lakehouse, rules, silver
from tidelake.sources.testdata import raw_tables


def reasons(spark, kind, texts):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    return [r[0] for r in df.select(rejects.rejection("c", kind)).collect()]


def test_reasons_of_numbers(spark):
    texts = ["1", " 2.5 ", None, "", " ", "1d", "0x1p3", "NaN", "Infinity", "1e400", "1e300", "free"]
    lost = [None] * 5 + ["unreadable"] * 4
    assert reasons(spark, "double", texts) == [*lost, "does_not_fit", None, "unreadable"]
    assert reasons(spark, "money", texts) == [*lost, "does_not_fit", "beyond_money", "unreadable"]
    assert reasons(spark, "bigint", ["7", "99999999999999999999", "x", None]) == [
        None, "does_not_fit", "unreadable", None,
    ]


def test_reasons_of_other_kinds(spark):
    assert reasons(spark, "timestamp", ["2018-01-01", "10:30", "2018-13-01", None, ""]) == [
        None, "unreadable", "unreadable", None, None,
    ]
    assert reasons(spark, "consent", ["yes", "maybe", None]) == [None, "unreadable", None]
    assert reasons(spark, "string", ["anything", None]) == [None, None]


@pytest.mark.parametrize("kind", [k for k, found in rejects.REASONS.items() if found])
def test_a_cell_is_in_the_ledger_exactly_if_typing_loses_it(spark, kind):
    texts = ["1", "1.5", "1e300", "1e400", "x", "", None, "2018-01-01", "2018-01", "true", "NaN", "-3"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    lost = S.clean_string("c").isNotNull() & S.READERS[kind]("c").isNull()
    rows = df.select(rejects.rejection("c", kind).alias("r"), lost.alias("lost")).collect()
    assert all((r["r"] in ("unreadable", "does_not_fit")) == r["lost"] for r in rows)


def test_ledger_names_records_and_counts_repeats(spark):
    raw = spark.createDataFrame(
        [("1", "a ", "1", "x"), ("1", "a ", "1", "x"), ("2", None, "no", "3")],
        "k string, l string, n string, m string",
    )
    found = rejects.rejected_cells(raw, "d", ["k", "l"], {"n": "bigint", "m": "double"})
    assert sorted(map(tuple, found.collect())) == [
        ("d", "1|a", "m", "x", "unreadable"),
        ("d", "1|a", "m", "x", "unreadable"),
        ("d", "2|", "n", "no", "unreadable"),
    ]
    kinds = {"d": {"n": "bigint", "m": "double", "p": "money"}}
    checks = {
        r["check_name"]: (r["status"], r["severity"], r["observed_value"])
        for r in rejects.ledger_checks(found, kinds).collect()
    }
    assert checks["m_unreadable"] == ("FAIL", "warning", "2")
    assert checks["n_unreadable"] == ("FAIL", "warning", "1")
    assert checks["n_does_not_fit"] == ("PASS", "warning", "0")
    assert checks["p_beyond_money"] == ("PASS", "critical", "0")
    assert len(checks) == 7


def test_every_typed_column_exists_in_its_raw_table(spark, sf):
    raw = raw_tables(spark, sf)
    for name, (source, _) in silver.SILVER.items():
        columns = raw[source].withColumnsRenamed(silver.PRODUCT_RENAMES).columns
        assert {*silver.KINDS[name], *silver.RECORD_KEYS[name]} <= {*columns}


def test_huge_amounts_end_no_job_and_are_counted(spark, sf, tmp_path):
    """Gold, its validation and the ledger checks over items with amounts no decimal holds."""
    raw = raw_tables(spark, sf)
    price = F.when(F.col("order_item_id") == "1", "1e300").otherwise(F.col("price"))
    raw["order_items"] = raw["order_items"].withColumn("price", price)
    house = lakehouse.build(raw, str(tmp_path), "r1")
    lost = raw["order_items"].where("order_item_id = '1'").count()
    checks = {
        (r["dataset"], r["check_name"]): r
        for r in rules.validate_typing(house.silver, house.rejected).collect()
    }
    row = checks["silver_order_items", "price_beyond_money"]
    assert (row["status"], row["severity"], row["observed_value"]) == ("FAIL", "critical", str(lost))
    assert checks["silver_order_items", "price_within_money"]["observed_value"] == str(lost)
    results = rules.validate_gold(house.gold, house.silver, house.counters).collect()
    revenue = [r["status"] for r in results if r["check_name"].endswith("_revenue_reconciles")]
    assert len(revenue) == 15 and set(revenue) == {"PASS"}
    # The sums hold all other amounts.
    others = house.silver["silver_order_items"].where("price < 1e200").select("order_id", "price")
    delivered = house.silver["silver_orders"].where("lower(order_status) = 'delivered'")
    expected = others.join(delivered, "order_id", "left_semi").agg(F.sum(S.money("price"))).first()[0]
    found = house.gold["gold_daily_sales"].agg(F.sum(S.money("product_revenue"))).first()[0]
    assert found == expected


def test_contract_numbers_are_read_like_silver_numbers(spark):
    df = spark.createDataFrame([(t,) for t in ("1", "1.5", "1d", "0x1p3", "NaN", None)], "c string")
    assert [r[0] for r in df.select(contracts.type_violation("c", "decimal")).collect()] == [
        False, False, True, True, True, False,
    ]
    assert [r[0] for r in df.select(contracts.type_violation("c", "integer")).collect()] == [
        False, True, True, True, True, False,
    ]


def test_rounding_keeps_numbers_beyond_decimals(spark):
    df = spark.createDataFrame([(1.25,), (1e300,), (None,)], "v double")
    assert [r[0] for r in S.round_numeric(df, {"v": 1}).collect()] == [1.3, 1e300, None]


def test_gold_amounts_come_in_cents(spark, sf):
    built = gold.build_gold("gold_daily_sales", gold.item_enriched(silver.build_silver(raw_tables(spark, sf), gold.GOLD_INPUTS)))
    assert built.where("product_revenue is null").count() == 0


CELLS = [
    None, "", " ", "\t1 ", "1", "1.5", "1e300", "-1e400", "x", "NaN", "99999999999999999999",
    "12345678901234567.89", "9999999999999999.99", "9999999999999999.999", "999999999999999.99",
    "2018-01-01", "2018-13-01", "2018-01", "yes", "NO ", "1d", "-.5e3", "\x0b2018-01-01 10:00:00\f",
]


def test_cells_read_in_steps_are_those_of_the_readers(spark):
    kinds = {k: k for k in S.READERS}
    df = spark.createDataFrame([(c,) * len(kinds) for c in CELLS], ", ".join(f"{k} string" for k in kinds))
    wanted = df.select(*[S.READERS[k](F.col(f"`{k}`")).cast("string") for k in kinds]).collect()
    steps = S.typed_cells(df, kinds)
    found = steps.select(*[F.col(f"_cell{i}").cast("string") for i in range(len(kinds))]).collect()
    assert list(map(tuple, found)) == list(map(tuple, wanted))
    for kind in (k for k in kinds if rejects.REASONS[k]):
        reasons_of = df.select(F.col(f"`{kind}`"), rejects.rejection(F.col(f"`{kind}`"), kind).alias("r"))
        lost = sorted(tuple(r) for r in reasons_of.collect() if r["r"])
        rows = rejects.rejected_cells(df, "d", [kind], {kind: kind})
        assert sorted((r["raw_text"], r["reason"]) for r in rows.collect()) == lost


def test_the_ledger_reads_a_text_once(spark):
    """Each reading stands once in the plan, so the work a cell does not grow with its mentions."""
    df = spark.createDataFrame([("1", "2")], "k string, n string")
    ledger = rejects.rejected_cells(df, "d", ["k"], {"n": "money"})
    plan = ledger._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("as double") == 1
