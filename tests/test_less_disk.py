"""A build shuffles and writes little, and leaves no shuffle files of its writes behind."""

import os
import random

import pytest
from pyspark.sql import functions as F

from registry import governance
from tidelake import session
from tidelake.operators import duplicates
from tidelake.plans import gold, lakehouse, silver
from tidelake.sources.testdata import raw_tables


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder(spark, monkeypatch, tmp_path):
    """A scratch folder of the test's own."""
    monkeypatch.setattr(session, "checkpoint_root", lambda spark: str(tmp_path))
    return str(tmp_path)


def shuffle_bytes(spark):
    """Bytes of the shuffle files on this machine's disk."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = [f for f in manager.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")]
    return sum(os.path.getsize(f) for f in files if os.path.exists(f))


def test_a_write_leaves_no_shuffle_files(spark, monkeypatch, tmp_path):
    folder(spark, monkeypatch, tmp_path)
    before = shuffle_bytes(spark)
    hashed = spark.range(400_000).select(F.xxhash64("id").alias("h"))
    assert session.written(hashed.distinct(), "kept").count() == 400_000
    assert shuffle_bytes(spark) - before < 1_000_000
    # The setting is the session's own again.
    assert spark.conf.get(session._CLEANUP, None) is None
    with session.shuffles_dropped(spark):
        with session.shuffles_dropped(spark):
            pass
        assert spark.conf.get(session._CLEANUP) == "true"
    assert spark.conf.get(session._CLEANUP, None) is None


def test_a_table_is_written_in_other_files_without_a_shuffle(spark, monkeypatch, tmp_path):
    root = folder(spark, monkeypatch, tmp_path)
    df = spark.range(1000).selectExpr("id", "if(id % 7 = 0, null, concat('t', id)) t").coalesce(1)
    found = session.dealt_anew(df, "raw")
    assert found.dtypes == df.dtypes and rows(found) == rows(df)
    (path,) = os.listdir(root)
    folders = [d for d in os.listdir(f"{root}/{path}") if d.startswith("_turn=")]
    assert len(folders) == 13
    one = spark.read.parquet(f"{root}/{path}/_turn=3").select("id")
    assert sorted(r[0] for r in one.collect()) == list(range(3, 1000, 13))
    assert rows(session.dealt_anew(df.limit(0), "none")) == []


def test_the_raw_tables_of_the_second_build_are_written_again(spark, sf, monkeypatch):
    given = {}

    def build(raw, *args):
        given.update(raw)
        raise InterruptedError

    monkeypatch.setattr(governance.lakehouse, "build", build)
    monkeypatch.setattr(governance, "built", lambda *args: None)
    with pytest.raises(InterruptedError):
        governance.determinism(spark, sf)
    tables = raw_tables(spark, sf)
    assert given.keys() == tables.keys()
    for name in ("orders", "sellers"):
        assert rows(given[name]) == rows(tables[name])
        assert all("/_turn=" in file for file in given[name].inputFiles())


def repeating(spark):
    """Repeated rows, rows that differ only in a NULL, zeros of both signs, NaN."""
    draw = random.Random(3)
    made = [(f"k{i % 900}", draw.choice([None, "a", "b"]), i % 5, float(i % 3)) for i in range(3000)]
    made += [("z", None, 0, 0.0), ("z", None, 0, -0.0), ("y", None, None, -0.0), ("n", "", 1, float("nan"))]
    made += [("n", "", 1, float("nan")), (None, None, None, None), (None, None, None, None), ("n", None, 1, None)]
    return spark.createDataFrame(made, "k string, t string, n int, x double").repartition(5)


@pytest.mark.parametrize("most", [2**20, 3])
def test_rows_are_made_distinct_by_their_cells(spark, monkeypatch, most):
    monkeypatch.setattr(duplicates, "MAX_REPEATED", most)
    df = repeating(spark)
    assert rows(duplicates.distinct_rows(df)) == rows(df.distinct())
    once = df.distinct().where("k is not null").withColumn("x", F.when(F.col("x") == 0, -0.0).otherwise(F.col("x")))
    assert rows(duplicates.distinct_rows(once)) == rows(once.distinct())
    assert rows(duplicates.distinct_rows(df.limit(0))) == []


def test_different_rows_with_one_hash_stay(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "row_hashes", lambda df: [F.xxhash64(F.col("n"))])
    df = repeating(spark)
    assert rows(duplicates.distinct_rows(df)) == rows(df.distinct())


def test_rows_that_do_not_repeat_are_not_shuffled(spark):
    df = spark.range(100).selectExpr("id", "concat('t', id) t", "cast(id as double) / 7 x")
    assert "Exchange" not in plan(duplicates.distinct_rows(df))


def items_of(spark):
    """Two orders under one id, products named twice, amounts that are no cents, parts missing."""
    draw = random.Random(9)
    made = []
    for i in range(600):
        price = draw.choice([19.99, 0.1, 1e300, 12345678901234.567, 0.005, None, -3.5, 0.0])
        freight = draw.choice([1.01, None, 0.3, 7.0])
        total = draw.choice([None, 5.5, "sum"])
        if total == "sum":
            total = None if price is None or freight is None else price + freight
        made.append((f"o{i % 90}" if i % 50 else None, i % 4, f"p{i % 7}" if i % 11 else None, f"s{i % 3}", price, freight, total))
    orders = [(f"o{i}", f"c{i % 20}", "Delivered" if i % 3 else "shipped", "2018-01-0%d 10:00:00" % (i % 3 + 1)) for i in range(80)]
    orders += [("o4", "c7", "DELIVERED", "2018-02-01 10:00:00"), ("o5", None, "delivered", "2018-01-03 11:00:00"), (None, "c1", "delivered", "2018-01-03 11:00:00")]
    frame = spark.createDataFrame(orders, "order_id string, customer_id string, order_status string, t string")
    return {
        "silver_order_items": spark.createDataFrame(
            made, "order_id string, order_item_id bigint, product_id string, seller_id string,"
            " price double, freight_value double, item_total_value double"),
        "silver_orders": frame.selectExpr("order_id", "customer_id", "order_status",
                                          "cast(t as timestamp) order_purchase_timestamp"),
        "silver_customers": spark.createDataFrame(
            [(f"c{i}", f"u{i // 2}", "sp" if i % 3 else None) for i in range(18)] + [("c3", "u9", "rj")],
            "customer_id string, customer_unique_id string, customer_state string"),
        "silver_products": spark.createDataFrame(
            [("p1", "toys"), ("p1", "cars"), ("p2", None), ("p3", "Toys"), (None, "toys"), ("p5", "none")],
            "product_id string, product_category_name string"),
        "silver_product_categories": spark.createDataFrame(
            [("toys", "toys"), ("cars", "cars"), ("cars", "autos")],
            "product_category_name string, product_category_name_english string"),
    }


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_the_item_table_by_order_is_the_item_table(spark, monkeypatch, broadcast):
    monkeypatch.setattr(gold, "FILTER_WORDS", 1)  # bits shared by many orders
    tables = items_of(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plain = gold.item_enriched(tables)
        marked = gold.marked(gold.item_enriched(tables, by_order=True))
        assert marked.drop(*gold.MARKS).schema == plain.schema
        assert rows(marked.drop(*gold.MARKS)) == rows(plain)
        assert plain.count() > 300
        for name in ("gold_public_sales_dashboard", "gold_product_category_revenue", "gold_customer_order_summary"):
            assert rows(gold.build_gold(name, marked)) == rows(gold.build_gold(name, plain))
        assert rows(gold.order_financials(marked)) == rows(gold.order_financials(plain))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_what_is_marked_is_shuffled_once(spark):
    plain = gold.item_enriched(items_of(spark))
    marked = session.written(gold.marked(plain), "items")
    for build in (gold.order_financials, gold.public_sales_dashboard):
        assert plan(build(marked)).count("Exchange") == 1
        assert plan(build(session.written(plain, "items"))).count("Exchange") == 2


def test_the_filter_of_orders_loses_no_item(spark):
    items = spark.range(5000).selectExpr("cast(id as string) order_id", "id n")
    orders = spark.range(0, 5000, 9).selectExpr("cast(id as string) order_id")
    kept = gold.among(items, orders)
    assert kept.columns == items.columns
    assert kept.join(orders, "order_id").count() == orders.count()
    assert kept.count() < 1000


def test_a_build_gives_the_tables_of_the_plain_builders(spark, sf, tmp_path):
    raw = raw_tables(spark, sf)
    house = lakehouse.build(raw, str(tmp_path), "r1", ("silver_orders", "silver_geolocation", *gold.GOLD))
    plain = silver.build_silver(raw, ["silver_orders", "silver_geolocation"])
    for name, df in plain.items():
        assert rows(house.frames[name]) == rows(df)
    items = gold.item_enriched(silver.build_silver(raw, gold.GOLD_INPUTS))
    for name in ("gold_public_sales_dashboard", "gold_daily_sales"):
        assert rows(house.frames[name]) == rows(gold.build_gold(name, items))
