"""Comparing two builds of a dataset from the top down.

The rows of a dataset fall into 16 ** DEPTH leaves by a hash of their key. A leaf's digest is the
number of its rows and order-free sums of their hashes; the digest of a node is the sum over its 16
children, up to one root. Two equal roots end a comparison. Otherwise only the children of nodes
that differ are looked at, and only the rows of the leaves that are left are compared one by one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.session import written
from tidelake.sources.sinks import row_hashes

FAN_OUT = 16
DEPTH = 3
SUMS = ("row_count", "sum_a", "sum_b")


def _leaf(key: list[str]) -> Column:
    cells = [part for k in key for part in (F.col(k).isNull(), F.col(k))]
    return F.pmod(F.xxhash64(F.lit("leaf"), *cells), F.lit(FAN_OUT**DEPTH)).cast("int")


def digest_tree(df: DataFrame, key: list[str]) -> DataFrame:
    """(level, node, row_count, sum_a, sum_b); level 0 is the root, and at most 4,369 nodes."""
    a, b = row_hashes(df)
    hashed = df.select(_leaf(key).alias("leaf"), a.alias("a"), b.alias("b"))
    leaves = hashed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(f"sum_{c}") for c in ("a", "b")],
    )
    places = [
        F.struct(
            F.lit(level).alias("level"),
            F.floor(F.col("leaf") / FAN_OUT ** (DEPTH - level)).cast("int").alias("node"),
        )
        for level in range(DEPTH + 1)
    ]
    nodes = leaves.select(*SUMS, F.inline(F.array(*places)))
    return nodes.groupBy("level", "node").agg(
        F.sum("row_count").alias("row_count"),
        *[F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS[1:]],
    )


def _differing(first: DataFrame, second: DataFrame, level: int) -> DataFrame:
    """Nodes of one level whose digests differ, or that only one tree has."""
    a = first.where(F.col("level") == level).select("node", *[F.col(c).alias(f"{c}_1") for c in SUMS])
    b = second.where(F.col("level") == level).select("node", *[F.col(c).alias(f"{c}_2") for c in SUMS])
    unequal = reduce(or_, [~F.col(f"{c}_1").eqNullSafe(F.col(f"{c}_2")) for c in SUMS])
    return a.join(b, "node", "full_outer").where(unequal).select("node")


def differing_leaves(first: DataFrame, second: DataFrame) -> DataFrame:
    """Leaves in which two digest trees differ, found from the root down: (leaf)."""
    nodes = _differing(first, second, 0)
    for level in range(1, DEPTH + 1):
        parents = nodes.select(F.col("node").alias("parent"))
        parent = F.floor(F.col("node") / FAN_OUT).cast("int")
        below = _differing(first, second, level)
        nodes = below.join(parents, parent == F.col("parent"), "left_semi")
    return nodes.select(F.col("node").alias("leaf"))


def changed_records(
    first: DataFrame, second: DataFrame, key: list[str], leaves: DataFrame | None = None
) -> DataFrame:
    """Records that two datasets do not share: (record_key, change).

    ``change`` is ``missing`` for a key that only the first has, ``added`` for one that only the
    second has, and ``changed`` otherwise. Rows outside ``leaves`` are not compared.
    """
    if leaves is None:
        leaves = differing_leaves(digest_tree(first, key), digest_tree(second, key))
    # At most 16 ** DEPTH leaves.
    opened = F.broadcast(leaves.withColumnRenamed("leaf", "_leaf"))
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])

    def rows(df: DataFrame, side: int) -> DataFrame:
        a, b = row_hashes(df)
        hashed = df.select(
            name.alias("record_key"), _leaf(key).alias("_leaf"), a.alias("a"), b.alias("b"),
            F.lit(side).alias("in_first"), F.lit(1 - side).alias("in_second"),
        )
        return hashed.join(opened, "_leaf", "left_semi")

    both = rows(first, 1).unionByName(rows(second, 0))
    copies = both.groupBy("record_key", "a", "b").agg(
        F.sum("in_first").alias("in_first"), F.sum("in_second").alias("in_second")
    )
    keyed = copies.groupBy("record_key").agg(
        F.sum("in_first").alias("in_first"),
        F.sum("in_second").alias("in_second"),
        F.max(F.col("in_first") != F.col("in_second")).alias("differs"),
    )
    change = (
        F.when(F.col("in_second") == 0, "missing")
        .when(F.col("in_first") == 0, "added")
        .otherwise("changed")
    )
    return keyed.where("differs").select("record_key", change.alias("change"))


def compare_builds(
    first: dict[str, DataFrame], second: dict[str, DataFrame], keys: dict[str, list[str]]
) -> DataFrame:
    """One row per dataset: whether both builds agree, and how many leaves and records do not.

    The trees of all datasets of a build are made and compared together.
    """

    def trees(build: dict[str, DataFrame]) -> DataFrame:
        parts = [
            digest_tree(build[n], keys[n]).select(F.lit(n).alias("dataset"), "*") for n in keys
        ]
        return written(reduce(DataFrame.unionByName, parts), "digest-trees")

    a, b = trees(first), trees(second)
    roots = [t.where("level = 0").select("dataset", *SUMS) for t in (a, b)]
    joined = roots[0].alias("a").join(roots[1].alias("b"), "dataset", "full_outer")
    equal = reduce(
        lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in SUMS]
    )
    state = joined.select(
        "dataset",
        F.coalesce("a.row_count", F.lit(0)).alias("row_count"),
        F.col("a.row_count").eqNullSafe(F.col("b.row_count")).alias("row_count_equal"),
        equal.alias("content_equal"),
    )
    unequal = [r["dataset"] for r in state.where("not content_equal").collect()]
    named = differing_counts(first, second, keys, unequal, a, b)
    result = state if named is None else state.join(named, "dataset", "left")
    lost = F.lit(0) if named is None else F.coalesce("records", F.lit(0))
    return result.select(
        "dataset",
        "row_count",
        "row_count_equal",
        "content_equal",
        lost.cast("bigint").alias("differing_records"),
        F.when(F.col("content_equal"), "PASS").otherwise("FAIL").alias("status"),
    )


def differing_counts(first, second, keys, unequal: list[str], a: DataFrame, b: DataFrame):
    """Differing records of the datasets whose roots differ; the others are not opened."""
    parts = []
    for name in unequal:
        own = [t.where(F.col("dataset") == name).drop("dataset") for t in (a, b)]
        records = changed_records(first[name], second[name], keys[name], differing_leaves(*own))
        parts.append(records.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("dataset"), "*"))
    return reduce(DataFrame.unionByName, parts) if parts else None
