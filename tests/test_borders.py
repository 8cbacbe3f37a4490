"""Border tables: groups that begin, end and lie whole in ranges, down to one row per range."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.operators import ranking


@pytest.fixture
def ranges(spark):
    """So many ranges, none of them put together again."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
             "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {n: spark.conf.get(n) for n in names}

    def of(number, batch=10_000):
        for n, value in zip(names, (number, "false", batch)):
            spark.conf.set(n, str(value))

    yield of
    for n, value in before.items():
        spark.conf.set(n, value)


def table(spark, seed, groups):
    draw = random.Random(seed)
    rows = [
        (i, draw.choice(groups), draw.choice([None, "x", "y"]), None if draw.random() < 0.1 else draw.randint(0, 30) / 4)
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "id int, g string, h string, v double")


# Ranges, rows of a batch, and groups: one that fills all ranges, a hot one, and many small ones.
RANGES = [
    (5, 3, 1, ["a"]),
    (12, 10_000, 2, ["a", "b"]),
    (16, 4, 3, ["hot"] * 20 + ["a", "b", None]),
    (1, 7, 3, ["hot"] * 20 + ["a", "b", None]),
    (16, 10_000, 4, [f"k{i}" for i in range(500)]),
]


@pytest.mark.parametrize("number,batch,seed,groups", RANGES)
def test_running_totals(spark, ranges, number, batch, seed, groups):
    df = table(spark, seed, groups)
    ranges(number, batch)
    found = ranking.running_total(df, ["g", "h"], ["v", "id"], F.col("id"), "upto")
    window = Window.partitionBy("g", "h").orderBy("v", "id")
    plain = df.withColumn("upto", F.sum("id").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


@pytest.mark.parametrize("number,batch,seed,groups", RANGES)
def test_quantiles(spark, ranges, number, batch, seed, groups):
    df = table(spark, seed, groups)
    ranges(number, batch)
    cuts = {"q25": ("v", 0.25), "mid": ("v", 0.5), "top": ("v", 1.0), "low": ("v", 0.0), "other": ("id", 0.9)}
    found = ranking.exact_quantiles(df, ["g"], cuts)
    plain = df.groupBy("g").agg(
        *[F.expr(f"percentile({c}, {q})").alias(n) for n, (c, q) in cuts.items()]
    )
    rounded = [
        sorted(((r["g"], *[None if r[n] is None else round(r[n], 9) for n in cuts]) for r in f.collect()), key=repr)
        for f in (found, plain)
    ]
    assert rounded[0] == rounded[1]


def test_no_group_and_no_rows(spark, ranges):
    df = table(spark, 5, ["a"])
    ranges(9)
    total = ranking.running_total(df, [], ["id"], F.lit(1), "n")
    assert sorted(r["n"] for r in total.collect()) == list(range(1, 601))
    assert total.columns == [*df.columns, "n"]
    assert ranking.exact_quantiles(df, [], {"m": ("id", 0.5)}).first()["m"] == 299.5
    assert ranking.occurrence_number(df.limit(0), ["g"], ["id"], "n").collect() == []
    assert ranking.exact_quantiles(df.limit(0), ["g"], {"m": ("id", 0.5)}).collect() == []


def test_nan_and_null_groups_are_one_group_each(spark, ranges):
    nan = float("nan")
    df = spark.createDataFrame([(i, nan if i % 2 else None) for i in range(50)], "id int, g double")
    ranges(6, 4)
    found = ranking.occurrence_number(df, ["g"], ["id"], "n").collect()
    assert max(r["n"] for r in found) == 25 and len({(r["id"] % 2, r["n"]) for r in found}) == 50


def test_the_records_are_shuffled_once(spark, ranges):
    ranges(4)
    plan = ranking.occurrence_number(table(spark, 6, ["a", "b"]), ["g"], ["id"], "n")
    text = plan._jdf.queryExecution().executedPlan().toString()
    # What is read back is joined with one broadcast row per range, and not dealt out again.
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_group_starts():
    groups = ranking._Groups(["a"])
    schema = pa.schema([("a", pa.string())])
    batches = [["x", "x", "y"], ["y"], [None, None], ["z"]]
    found = [groups.starts(pa.RecordBatch.from_arrays([pa.array(b, pa.string())], schema=schema)).tolist() for b in batches]
    assert found == [[2], [], [0], [0]]
