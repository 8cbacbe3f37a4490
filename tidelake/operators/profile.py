"""Column, dataset, date and numeric profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions.scalar import parse_timestamp, rounded_ratio
from tidelake.operators import ranking
from tidelake.operators.quality import duplicate_key_rows, union_all
from tidelake.session import small_table

SAMPLE_SIZE = 3


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text; negative zero is zero."""
    return df.select(
        *[
            (F.col(f"`{n}`") + 0.0 if t in ("double", "float") else F.col(f"`{n}`"))
            .cast("string")
            .alias(n)
            for n, t in df.dtypes
        ]
    )


def _smallest(dataset: str, size: int):
    """The smallest distinct texts of each column among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, pa.Array] = {}
        for batch in batches:
            for name, values in zip(batch.schema.names, batch.columns):
                some = pa.concat_arrays([best[name], values]) if name in best else values
                some = pc.unique(some.drop_null())
                best[name] = some.take(pc.select_k_unstable(some, size, [("", "ascending")]))
        rows = [(n, v) for n, values in best.items() for v in values.to_pylist()]
        names, texts = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([dataset] * len(rows), pa.string()), pa.array(names, pa.string()),
             pa.array(texts, pa.string())],
            names=["dataset", "column_name", "value"],
        )

    return run


def smallest_values(tables: dict[str, DataFrame], size: int = SAMPLE_SIZE) -> DataFrame:
    """The ``size`` smallest distinct values of every column of text tables, as one text.

    Each task keeps the smallest ones it sees, so it sends ``size`` rows a column and no more.
    """
    schema = "dataset string, column_name string, value string"
    found = union_all([df.mapInArrow(_smallest(n, size), schema) for n, df in tables.items()])
    kept = F.slice(F.sort_array(F.collect_set("value")), 1, size)
    return found.groupBy("dataset", "column_name").agg(
        F.array_join(kept, " | ").alias("sample_values")
    )


def _counts(df: DataFrame, dataset: str) -> DataFrame:
    """Rows, NULLs and distinct values of each column; values travel as 128-bit hashes."""
    names = df.columns
    hashed = df.select(
        *[
            F.when(
                F.col(f"`{c}`").isNotNull(),
                F.struct(F.xxhash64(F.lit("a"), f"`{c}`"), F.xxhash64(F.lit("b"), f"`{c}`")),
            ).alias(f"c{i}")
            for i, c in enumerate(names)
        ]
    )
    row = hashed.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count(f"c{i}").alias(f"filled{i}") for i in range(len(names))],
        *[F.count_distinct(f"c{i}").alias(f"distinct{i}") for i in range(len(names))],
    )
    parts = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.col("row_count") - F.col(f"filled{i}")).alias("null_count"),
            F.col(f"distinct{i}").alias("unique_count"),
        )
        for i, c in enumerate(names)
    ]
    return row.select(F.lit(dataset).alias("dataset"), "row_count", F.inline(F.array(*parts)))


def column_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of every table: rows, NULLs, distinct values and a few of them."""
    texts = {name: as_text(df) for name, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    names = small_table(
        spark,
        [(d, n, t) for d, df in tables.items() for n, t in df.dtypes],
        "dataset string, column_name string, dtype string",
    )
    counts = union_all([_counts(df, name) for name, df in texts.items()])
    by = ["dataset", "column_name"]
    joined = names.join(counts, by, "left").join(smallest_values(texts), by, "left")
    return joined.select(
        *by,
        "dtype",
        "row_count",
        "null_count",
        rounded_ratio(F.col("null_count") * 100, F.col("row_count"), 4).alias("null_percentage"),
        "unique_count",
        F.coalesce("sample_values", F.lit("")).alias("sample_values"),
    )


def column_profile(df: DataFrame, dataset: str) -> DataFrame:
    return column_profiles({dataset: df})


def dataset_profile(df: DataFrame, dataset: str, key: list[str] | None) -> DataFrame:
    """Rows, columns, repeated rows, and key faults; key figures are NULL without a key."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    if key:
        null_key = F.lit(False)
        for k in key:
            null_key = null_key | F.col(k).isNull()
        null_rows = F.coalesce(F.sum(F.when(null_key, F.col("n")).otherwise(0)), F.lit(0))
        duplicates = duplicate_key_rows(df, key).scalar()
    else:
        null_rows = duplicates = F.lit(None).cast("bigint")
    totals = copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_full_rows"),
        null_rows.alias("null_primary_key_rows"),
    )
    return totals.select(
        F.lit(dataset).alias("dataset"),
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        "duplicate_full_rows",
        duplicates.alias("duplicate_primary_key_rows"),
        "null_primary_key_rows",
    )


def date_ranges(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    parts = []
    for name in columns:
        stamp = parse_timestamp(name)
        parts.append(
            df.agg(
                F.min(stamp).alias("minimum"),
                F.max(stamp).alias("maximum"),
                F.count_if(stamp.isNull()).alias("invalid_or_missing_count"),
            ).select(F.lit(dataset).alias("dataset"), F.lit(name).alias("column_name"), "*")
        )
    return union_all(parts)


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _moments(name: str) -> list:
    value = F.col(name)
    return [
        F.count(name).alias("value_count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def numeric_summary(
    df: DataFrame, dataset: str, columns: list[str], places: int = 4
) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of numeric columns."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    cuts = {f"{n}_{c}": (c, q) for c in columns for n, q in QUARTILES.items()}
    found = ranking.exact_quantiles(numbers, [], cuts)
    moments = numbers.agg(*[F.struct(*_moments(c)).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("f")) for c in columns]
    figures = moments.select(F.explode(F.array(*pairs)).alias("r")).select("r.column_name", "r.f.*")
    quartiles = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}_{c}").alias(n) for n in QUARTILES])
        for c in columns
    ]
    laid = found.select(F.inline(F.array(*quartiles)))
    figures = figures.join(laid, "column_name", "left")
    return figures.select(
        F.lit(dataset).alias("dataset"),
        "column_name",
        "value_count",
        *[F.round(c, places).alias(c) for c in ("mean", "std", "min", *QUARTILES, "max")],
    )
