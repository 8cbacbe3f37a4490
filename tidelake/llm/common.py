"""Helpers shared by the text operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.session import tune

# The six characters that separate words in every operator here: blank and U+0009-U+000D.
SPACES = "\t\n\x0b\x0c\r "

# Texts may be long, so the Arrow batches sent to Python are bounded by bytes.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the text operators.

    Their functions travel to the executors with the plan, so that nothing has to be installed
    there.
    """
    tune(spark)
    cloudpickle.register_pickle_by_value(sys.modules["tidelake.llm"])
    for key, value in BATCH_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, also one that holds dots or blanks."""
    return df["`" + name.replace("`", "``") + "`"]


def text_of(df: DataFrame, name: str) -> Column:
    """The text column; NULL counts as the empty text."""
    return F.coalesce(column(df, name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than ``SPACES``."""
    for space in SPACES[:-1]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key as text leaves the remainder; a NULL key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus == remainder
