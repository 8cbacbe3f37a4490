"""Frames shared by the registered queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidelake.plans import gold, lakehouse, silver
from tidelake.session import PARQUET, scratch_path, shuffles_dropped, written
from tidelake.sources.testdata import RAW_SOURCES, RAW_TABLES, table

_BUILT: dict[tuple[str, str], lakehouse.Lakehouse] = {}
_RAW: dict[tuple[str, str, str], DataFrame] = {}

# Records of one file of a raw table: each can be read by a task of its own.
RAW_FILE_RECORDS = 20_000


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table as the adapter derives it; written on first use in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _RAW:
        df, path = RAW_TABLES[name](spark, sf_dir), scratch_path(spark, f"raw-{name}")
        with shuffles_dropped(spark):
            df.write.options(maxRecordsPerFile=RAW_FILE_RECORDS, **PARQUET).parquet(path)
        _RAW[key] = spark.read.schema(df.schema).parquet(path)
    return _RAW[key]


def raw_once(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table for a reader or two.

    The text of a large table costs more to write and read again than to derive as it is read. A
    table whose files give fewer splits than there are cores is written, so that its readers can
    share the work.
    """
    if (spark.sparkContext.applicationId, sf_dir, name) in _RAW:
        return raw(spark, sf_dir, name)
    splits = table(spark, sf_dir, RAW_SOURCES[name]).rdd.getNumPartitions()
    if splits < spark.sparkContext.defaultParallelism:
        return raw(spark, sf_dir, name)
    return RAW_TABLES[name](spark, sf_dir)


class RawZone(dict):
    """The raw tables, each taken when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.of = partial(raw_once, spark, sf_dir)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.of(name)
        return self[name]


def raw_zone(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: raw_once(spark, sf_dir, name) for name in RAW_TABLES}


def silver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, build = silver.SILVER[name]
    return build(raw_once(spark, sf_dir, source))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.item_enriched({n: silver_table(spark, sf_dir, n) for n in gold.GOLD_INPUTS})


def gold_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frame = items(spark, sf_dir)
    if name == "gold_customer_order_summary":  # it reads the items twice
        frame = written(frame, "items")
    return gold.build_gold(name, frame)


def built(spark: SparkSession, sf_dir: str, *names: str) -> lakehouse.Lakehouse:
    """The written Silver and Gold tables, or those named; built on first use in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        root = scratch_path(spark, "lakehouse")
        _BUILT[key] = lakehouse.Lakehouse(RawZone(spark, sf_dir), root, "run-1")
    return _BUILT[key].add(*(names or lakehouse.EVERYTHING))
