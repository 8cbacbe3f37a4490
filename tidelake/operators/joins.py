"""Joins that need more than ``DataFrame.join``.

Join strategy is left to AQE: it broadcasts a side only when the measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and splits hot keys of sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A join key that must be unique is not."""


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows")).where("key_rows > 1")


def checked_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    validate: str = "many_to_one",
) -> DataFrame:
    """Join that fails when a side declared "one" repeats a key."""
    left_rule, right_rule = validate.split("_to_")
    for side, rule, df in (("left", left_rule, left), ("right", right_rule, right)):
        if rule == "one":
            examples = duplicate_keys(df, keys).take(3)
            if examples:
                raise CardinalityError(f"{side} side is not unique on {keys}: {examples}")
    return left.join(right, keys, how)


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent. A NULL key counts as an orphan."""
    parents = parent.select(F.col(parent_key).alias("_parent_key"))
    return child.join(parents, child[child_key] == parents["_parent_key"], "left_anti")


@dataclass(frozen=True)
class Edge:
    """A relationship: the key column of a child table and of the parent table it points to."""

    name: str
    child: str
    key: str
    parent: str
    parent_key: str


def edge_keys(tables: dict[str, DataFrame], edges: Iterable[Edge]) -> DataFrame:
    """Every key of every edge once, as text: (edge, key, children, parents).

    Each table is read once, whatever edges it is part of: a row gives its keys with the edge and
    the side they are on, and one grouping, combined on the map side, brings both sides together.
    """
    sides: dict[str, list[Column]] = {}
    for edge in edges:
        for table, key, child in ((edge.child, edge.key, 1), (edge.parent, edge.parent_key, 0)):
            sides.setdefault(table, []).append(
                F.struct(
                    F.lit(edge.name).alias("edge"),
                    F.col(key).cast("string").alias("key"),
                    F.lit(child).cast("bigint").alias("children"),
                    F.lit(1 - child).cast("bigint").alias("parents"),
                )
            )
    parts = [tables[name].select(F.inline(F.array(*cells))) for name, cells in sides.items()]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("edge", "key")
        .agg(F.sum("children").alias("children"), F.sum("parents").alias("parents"))
    )


def without_parent() -> Column:
    """Whether the children of an ``edge_keys`` row are orphans; a NULL key has no parent."""
    return F.col("key").isNull() | (F.col("parents") == 0)


def two_way_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side without a partner on all keys."""
    missing = expected.join(actual, keys, "left_anti").select(
        F.lit("missing_or_misordered").alias("issue_type"), *keys
    )
    unexpected = actual.join(expected, keys, "left_anti").select(
        F.lit("unexpected_or_misordered").alias("issue_type"), *keys
    )
    return missing.unionByName(unexpected)


def compare_manifests(
    first: DataFrame, second: DataFrame, key: str, values: list[str]
) -> DataFrame:
    """Full outer comparison of two manifests, one row per key."""
    a, b = first.alias("a"), second.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    equal = {
        v: F.col(f"a.{v}").isNotNull() & F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
        for v in values
    }
    present = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull()
    matches = reduce(and_, equal.values(), present)
    return joined.select(
        F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key),
        *[c.alias(f"{v}_equal") for v, c in equal.items()],
        F.when(matches, "PASS").otherwise("FAIL").alias("status"),
    )
