"""Dropping repeated rows of large tables in which few rows repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.session import written
from tidelake.sources.sinks import row_hashes

# Hashes of repeated rows that are sent to the tasks: 8 MB. Beyond it whole rows are shuffled.
MAX_REPEATED = 2**20


def repeated_hashes(df: DataFrame) -> DataFrame:
    """(_hash) of rows that occur twice or more, and of different rows that share a hash."""
    hashed = df.select(row_hashes(df)[0].alias("_hash"))
    return hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_hash")


def _zero(df: DataFrame, name: str) -> Column:
    """A double as grouping gives it: there is one zero."""
    if df.schema[name].dataType.typeName() not in ("double", "float"):
        return F.col(name)
    return F.when(F.col(name) == 0, F.abs(name)).otherwise(F.col(name)).alias(name)


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df.distinct()`` that shuffles a hash of each row, and whole rows only where hashes repeat.

    The table is read once for the hashes and again for the rows, which stay in their order. Rows
    are told apart by their cells: a shared hash only says which rows are compared.
    """
    repeated = written(repeated_hashes(df), "repeated")
    count = repeated.count()
    if count > MAX_REPEATED:
        return df.distinct()
    alone = df
    if count:
        few = F.broadcast(repeated)
        hashed = df.withColumn("_hash", row_hashes(df)[0])
        alone = hashed.join(few, "_hash", "left_anti")
        copies = hashed.join(few, "_hash", "left_semi").select(*df.columns).distinct()
    alone = alone.select(*[_zero(df, c) for c in df.columns])
    return alone.unionByName(copies) if count else alone
