"""Hot groups take another way to the same result; results do not depend on partitions."""

import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.operators import profile, ranking
from tidelake.plans import gold, silver
from tidelake.sources import sinks
from tidelake.sources.testdata import raw_tables


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; keys and values may be NULL; values repeat."""
    draw = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else draw.choice(["a", "b", "c", None, f"k{i % 200}"])
        value = None if draw.random() < 0.05 else float(draw.randint(0, 400))
        rows.append((i, key, value))
    return spark.createDataFrame(rows, "id bigint, key string, value double").repartition(7)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_occurrence_number_same_with_hot_groups(skewed):
    args = (["key"], ["value", "id"], "position")
    window = Window.partitionBy("key").orderBy("value", "id")
    plain = skewed.withColumn("position", F.row_number().over(window).cast("bigint"))
    assert collected(ranking.occurrence_number(skewed, *args)) == collected(plain)


def test_quantiles_same_with_hot_groups_and_brute_force(skewed):
    cuts = {"low": ("value", 0.25), "mid": ("value", 0.5), "other": ("id", 0.9)}
    spread = ranking.exact_quantiles(skewed, ["key"], cuts)
    groups = {}
    for row in skewed.collect():
        groups.setdefault(row["key"], []).append(row["value"])
    known = {k: [x for x in v if x is not None] for k, v in groups.items()}
    got = {r["key"]: r["mid"] for r in spread.collect()}
    assert got == {k: statistics.median(v) if v else None for k, v in known.items()}


def test_quantiles_of_random_doubles_do_not_depend_on_partitions(spark):
    """No rounding: the same formula for every group size and every partitioning."""
    draw = random.Random(8)
    rows = [(draw.randint(0, 40), draw.gauss(0, 1e6)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "key int, value double")
    cuts = {"low": ("value", 0.25), "mid": ("value", 0.5), "high": ("value", 0.9)}
    found = [
        collected(ranking.exact_quantiles(df.repartition(n), ["key"], cuts)) for n in (1, 5, 16)
    ]
    assert found[0] == found[1] == found[2]
    groups = {}
    for key, value in rows:
        groups.setdefault(key, []).append(value)

    def cut(values, q):
        values = sorted(values)
        at = (len(values) - 1) * q
        low = values[math.floor(at)]
        return low + (values[math.ceil(at)] - low) * (at - math.floor(at))

    assert found[0] == collected(
        spark.createDataFrame(
            [(k, *[cut(v, q) for _, q in cuts.values()]) for k, v in groups.items()],
            "key int, low double, mid double, high double",
        )
    )


def test_global_summary(skewed):
    row = profile.numeric_summary(skewed, "d", ["value", "id"]).where("column_name = 'value'").first()
    values = sorted(r["value"] for r in skewed.collect() if r["value"] is not None)
    assert row["value_count"] == len(values)
    assert row[[c for c in row.asDict() if "50" in c or "median" in c][0]] == statistics.median(values)


def test_mode_tie_goes_to_smallest_and_nulls_do_not_count(spark):
    rows = [("x", "b"), ("x", "a"), ("x", None), ("x", None), ("y", None)]
    found = ranking.representative_mode(spark.createDataFrame(rows, "k string, v string"), ["k"], "v")
    assert collected(found) == [("x", "a")]


def test_reviews_and_geolocation_do_not_depend_on_partitions(spark, sf):
    raw = raw_tables(spark, sf)
    for build, table in (
        (silver.silver_reviews, "order_reviews"),
        (silver.silver_geolocation, "geolocation"),
    ):
        assert collected(build(raw[table])) == collected(build(raw[table].repartition(13)))


@pytest.mark.parametrize("name", sorted(gold.GOLD))
def test_gold_is_the_same_under_any_partitioning(spark, sf, name):
    raw = raw_tables(spark, sf)

    def digest(partitions):
        spread = {n: df.repartition(partitions) for n, df in raw.items()}
        tables = silver.build_silver(spread, gold.GOLD_INPUTS)
        built = gold.build_gold(name, gold.item_enriched(tables))
        return sinks.content_hash(built).first()

    assert digest(1) == digest(16)


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    money = df.withColumn("v", F.col("v").cast("decimal(18,2)"))
    shares = ranking.with_share_of_total(money, "v", "share")
    assert {r["k"]: r["share"] for r in shares.collect()} == {"a": 33.33, "b": 66.67}
