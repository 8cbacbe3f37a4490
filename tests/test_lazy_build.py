"""A query builds the datasets it reads and no others; a raw table read once is not written."""

import os

import pytest
from registry import inputs
from tidelake.plans import lakehouse, rules, silver
from tidelake.sources.testdata import raw_tables


def zones(root):
    """Dataset folders that were written."""
    return {d for z in ("silver", "gold/internal", "gold/public", "quarantine")
            if os.path.isdir(f"{root}/{z}") for d in os.listdir(f"{root}/{z}")}


@pytest.fixture(scope="module")
def whole(spark, sf, tmp_path_factory):
    return lakehouse.build(raw_tables(spark, sf), str(tmp_path_factory.mktemp("whole")), "r1")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_only_what_a_dataset_needs_is_written(spark, sf, tmp_path, whole):
    house = lakehouse.Lakehouse(raw_tables(spark, sf), str(tmp_path), "r1")
    house.add(*rules.tables_of([rules.COVERAGE]))
    assert zones(tmp_path) == {"silver_customer_contact", "silver_customers"}
    assert rows(rules.contact_coverage(house.silver)) == rows(rules.contact_coverage(whole.silver))
    name = "gold_product_category_revenue"
    house.add(name)
    assert zones(tmp_path) == {
        "silver_customer_contact", "silver_customers", "silver_orders", "silver_order_items",
        "silver_products", "silver_product_categories", "item_enriched", name,
    }
    assert rows(house.gold[name]) == rows(whole.gold[name])


def test_datasets_built_in_parts_are_those_built_at_once(spark, sf, tmp_path, whole):
    house = lakehouse.Lakehouse(raw_tables(spark, sf), str(tmp_path), "r1")
    for name in reversed(lakehouse.EVERYTHING):
        house.add(name).add(name)
    assert list(house.silver) == list(whole.silver) and list(house.gold) == list(whole.gold)
    assert house.counters == whole.counters
    for name in ("silver_orders", "gold_daily_sales", "gold_customer_order_summary"):
        assert rows(house.frames[name]) == rows(whole.frames[name])
    assert rows(house.rejected) == rows(whole.rejected)


def test_a_large_raw_table_is_not_written_for_one_reader(spark, sf, tmp_path):
    """Eight files give eight splits: the items are derived as they are read."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    packed = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        derived = inputs.raw_once(spark, str(tmp_path), "order_items")
        plan = derived._jdf.queryExecution().optimizedPlan().toString()
        assert "l_extendedprice" in plan
        # The amount of an item is made into a decimal once, whatever mentions it.
        assert plan.count("as decimal(12,2)") == 1
        assert rows(derived) == rows(inputs.raw(spark, sf, "order_items"))
        found = silver.silver_order_items(derived)
        assert rows(found) == rows(inputs.silver_table(spark, sf, "silver_order_items"))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", packed)


def test_a_small_raw_table_is_written_in_files_for_its_readers(spark, sf):
    small = inputs.raw_once(spark, sf, "sellers")
    assert "s_suppkey" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert rows(small) == rows(raw_tables(spark, sf)["sellers"])
