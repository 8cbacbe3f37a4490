"""Session settings and the shared scratch folder."""

from __future__ import annotations

import json
import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions that tasks run travel with the plan: nothing has to be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules["tidelake"])

# Runtime SQL settings every job relies on. AQE picks join strategies and partition
# counts from measured sizes, so nothing here depends on the size of one cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Columnar files grow several times in memory: judge a broadcast by that size, not by
    # the compressed one. AQE still broadcasts a side it has measured to be small.
    "spark.sql.sources.fileCompressionFactor": "6.0",
    # Split a hot join key even where the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Static setting, for sessions made here: plans are built from many column expressions,
# so the call site of each is not recorded.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# Written tables are read a few times and kept until the cluster clears them: a third smaller.
PARQUET = {"compression": "zstd"}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITES: dict[int, tuple[int, str | None]] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "tidelake", memory: str = "8g") -> SparkSession:
    """Single-JVM session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**RUNTIME_CONF, **START_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back
    to a temporary folder, because there every task sees the same disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a folder that all executors share"
            )
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one written intermediate table; never reused."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, what a write has shuffled is deleted when the write has ended.

    Otherwise it stays on the executors' disks until the driver happens to collect its garbage. A
    table that is written is read from its files. Writes may run at the same time; after the last
    one the setting is as it was.
    """
    with _LOCK:
        writes, before = _WRITES.get(id(spark), (0, spark.conf.get(_CLEANUP, None)))
        _WRITES[id(spark)] = (writes + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            writes, before = _WRITES.pop(id(spark))
            if writes > 1:
                _WRITES[id(spark)] = (writes - 1, before)
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write a table to a path that is not there yet and read it back."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("errorifexists").options(**PARQUET).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder once and read it back.

    Cuts the lineage: its readers share one computation, prune its columns, and survive
    the loss of any executor.
    """
    return write_parquet(df, scratch_path(df.sparkSession, label))


def dealt_anew(df: DataFrame, label: str, folders: int = 13) -> DataFrame:
    """Write a table in other files: the rows of a task go to so many folders in turn.

    Its readers get the rows in another order and grouped in another way. Nothing is shuffled.
    """
    path = scratch_path(df.sparkSession, label)
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(folders))
    rows = df.withColumn("_turn", turn).write.options(**PARQUET)
    rows.partitionBy("_turn").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few configuration rows as a table, read by the JVM from one JSON literal."""
    names = T.StructType.fromDDL(schema).names
    document = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.sql(
        "select inline(from_json(:document, :schema))",
        args={"document": document, "schema": f"array<struct<{schema}>>"},
    )
