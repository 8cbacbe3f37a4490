"""Digest trees: equal builds, and every kind of difference found by its key."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidelake.operators import determinism as D
from tidelake.sources import sinks


@pytest.fixture(scope="module")
def build(spark):
    rows = [(i, f"k{i % 7}", None if i % 11 == 0 else i / 3) for i in range(2000)]
    return spark.createDataFrame(rows, "id bigint, k string, v double")


def names(df):
    return sorted(map(tuple, df.collect()))


def test_trees_do_not_depend_on_partitions(build):
    one, two = (D.digest_tree(build.repartition(n), ["id"]) for n in (1, 9))
    assert names(one) == names(two)
    assert D.differing_leaves(one, two).count() == 0
    root = one.where("level = 0").collect()
    assert len(root) == 1 and root[0]["row_count"] == 2000
    assert one.where(f"level = {D.DEPTH}").agg(F.sum("row_count")).first()[0] == 2000


def test_each_change_is_found_by_its_key(spark, build):
    other = (
        build.where("id <> 17")
        .withColumn("v", F.when(F.col("id") == 400, -1.0).otherwise(F.col("v")))
        .withColumn("k", F.when(F.col("id") == 11, F.lit(None)).otherwise(F.col("k")))
        .unionByName(spark.createDataFrame([(9999, "new", 1.0)], build.schema))
    )
    assert names(D.changed_records(build, other, ["id"])) == [
        ("11", "changed"), ("17", "missing"), ("400", "changed"), ("9999", "added"),
    ]


def test_a_repeated_row_is_a_change(build):
    twice = build.unionByName(build.where("id = 5"))
    assert names(D.changed_records(build, twice, ["id"])) == [("5", "changed")]


def test_only_differing_leaves_are_opened(build):
    other = build.withColumn("v", F.when(F.col("id") == 400, -1.0).otherwise(F.col("v")))
    trees = [D.digest_tree(df, ["id"]) for df in (build, other)]
    leaves = D.differing_leaves(*trees)
    assert leaves.count() == 1
    # A leaf that holds no change gives nothing, whatever differs elsewhere.
    wrong = leaves.select(((F.col("leaf") + 1) % D.FAN_OUT**D.DEPTH).alias("leaf"))
    assert D.changed_records(build, other, ["id"], wrong).count() == 0


def test_compare_builds_reports_each_dataset(build):
    other = build.withColumn("v", F.when(F.col("id") % 500 == 1, -1.0).otherwise(F.col("v")))
    found = D.compare_builds(
        {"same": build, "not": build, "less": build},
        {"same": build.repartition(3), "not": other, "less": build.where("id > 3")},
        {"same": ["id"], "not": ["id"], "less": ["id", "k"]},
    )
    rows = {r["dataset"]: r for r in found.collect()}
    assert (rows["same"]["status"], rows["same"]["differing_records"]) == ("PASS", 0)
    assert (rows["not"]["status"], rows["not"]["differing_records"]) == ("FAIL", 4)
    assert rows["not"]["row_count_equal"] and not rows["less"]["row_count_equal"]
    assert rows["less"]["differing_records"] == 4


def test_empty_builds_are_equal(build):
    none = build.limit(0)
    assert D.changed_records(none, none, ["id"]).count() == 0
    assert D.changed_records(none, build.where("id = 3"), ["id"]).first()["change"] == "added"


# The portable digest, against another implementation of it.


def text_of(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return {"inf": "inf", "-inf": "-inf"}.get(str(value), "nan")
        if value == 0:
            return "0"
        bits = struct.unpack(">Q", struct.pack(">d", abs(value)))[0]
        exponent, fraction = bits >> 52, bits & ((1 << 52) - 1)
        if exponent:
            mantissa, power = fraction | 1 << 52, exponent - 1023
        else:  # below the normal range: shift the leading bit into its place
            shift = 53 - fraction.bit_length()
            mantissa, power = fraction << shift, -1022 - shift
        return f"{'-' if value < 0 else ''}{mantissa}p{power}"
    return str(value)


def digest(names, rows):
    sums = [0] * 8
    for row in rows:
        cells = ["-" if t is None else f"{len(t.encode())}:{t}" for t in map(text_of, row)]
        whole = hashlib.sha256("".join(cells).encode()).hexdigest()
        sums = [s + int(whole[8 * i : 8 * i + 8], 16) for i, s in enumerate(sums)]
    parts = [",".join(names), str(len(rows)), *map(str, sums)]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def test_content_digest_can_be_worked_out_elsewhere(spark):
    draw = random.Random(3)
    doubles = [0.0, -0.0, 1.0, -1.5, 0.1, 1e300, 5e-324, 2.2e-308, 1e-310, 2.0**52, 2.0**-30, 3e8 - 2**-20]
    doubles += [draw.uniform(-1, 1) * 10 ** draw.randint(-300, 300) for _ in range(300)]
    doubles += [2.0**k for k in range(-1074, 1024, 37)]
    doubles += [float("nan"), float("inf"), float("-inf"), None]
    rows = [(i, x, f"é{i}|" if i % 3 else None, i % 2 == 0) for i, x in enumerate(doubles)]
    df = spark.createDataFrame(rows, "i bigint, x double, s string, b boolean").repartition(5)
    found = sinks.content_hash(df).first()
    assert found["content_sha256"] == digest(df.columns, rows)
    assert (found["row_count"], found["column_count"]) == (len(rows), 4)


def test_content_digest_of_times_and_nothing(spark):
    df = spark.sql("select timestamp'2018-01-02 03:04:05.000006' t, date'1969-12-31' d")
    micros = 1514862245000006
    assert sinks.content_hash(df).first()["content_sha256"] == digest(["t", "d"], [(micros, -1)])
    assert sinks.content_hash(df.limit(0)).first()["content_sha256"] == digest(["t", "d"], [])


def test_cells_cannot_run_into_each_other(spark):
    def sha(*row):
        return sinks.content_hash(spark.createDataFrame([row], "a string, b string")).first()[2]

    assert len({sha("1:a", ""), sha("", "1:a"), sha("1", ":a"), sha(None, "-"), sha("-", None)}) == 5


def test_a_digest_sums_whole_numbers_inside_a_partition(spark):
    """One reading of 16 digits gives two parts, and exponents are found once a double."""
    df = spark.range(40).selectExpr("id", "cast(id as double) / 7 as x")
    found = [sinks.content_hash(df.repartition(n)).first() for n in (1, 7)]
    assert found[0] == found[1] and found[0]["row_count"] == 40
    plan = sinks.content_hash(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") == 4 and plan.count("LOG2(") == 1


def test_a_digest_adds_the_digests_of_rows(spark):
    doubles = [0.0, -0.0, 1.5, float("nan"), float("inf"), None, 1e308, 5e-324, 0.1, 7.999999999999999]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(doubles)], "i int, x double")
    rows = [r[0] for r in df.select(sinks.row_digest(df)).collect()]
    sums = [str(sum(int(d[8 * i : 8 * i + 8], 16) for d in rows)) for i in range(8)]
    text = "|".join(["i,x", str(len(rows)), *sums])
    found = sinks.content_hash(df).first()["content_sha256"]
    assert found == hashlib.sha256(text.encode()).hexdigest()
