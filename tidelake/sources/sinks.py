"""Writers: zone paths, dataset manifests, snapshots and table integrity."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.session import write_parquet

ZONES = ("silver", "gold/internal", "gold/public", "quarantine")


def zone_path(root: str, zone: str, dataset: str, run_id: str) -> str:
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone}")
    return f"{root.rstrip('/')}/{zone}/{dataset}/{run_id}"


def write_dataset(df: DataFrame, root: str, zone: str, dataset: str, run_id: str) -> DataFrame:
    """Write to a path of its own for this run, never over an older one; read it back."""
    written = write_parquet(df, zone_path(root, zone, dataset, run_id))
    written.createOrReplaceTempView(dataset)
    return written


def row_hashes(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of a row; a NULL counts with its position."""
    cells = [part for c in df.columns for part in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *cells) for seed in ("first", "second")]


def _exact_double(value: Column) -> Column:
    """A double as sign, whole mantissa and exponent of two, exactly and in any engine alike."""
    size = F.abs(value)
    power = _near_power(size)
    return _double_text(value, _not_below(size, _not_above(size, power)))


def _near_power(size: Column, power: str = "") -> Column:
    return F.floor(F.log2(size))


def _power(power: Column | str) -> Column:
    return F.col(power) if isinstance(power, str) else power


def _not_above(size: Column, power: Column | str) -> Column:
    near = _power(power)
    return near - F.when(F.pow(F.lit(2.0), near) > size, 1).otherwise(0)


def _not_below(size: Column, power: Column | str) -> Column:
    near = _power(power)
    return near + F.when(F.pow(F.lit(2.0), near + 1) <= size, 1).otherwise(0)


def _double_text(value: Column, power: Column) -> Column:
    size = F.abs(value)
    mantissa = (size / F.pow(F.lit(2.0), power) * float(2**52)).cast("bigint")
    sign = F.when(value < 0, "-").otherwise("")
    infinite = size == F.lit(float("inf"))
    return (
        F.when(F.isnan(value), "nan")
        .when(infinite, F.concat(sign, F.lit("inf")))
        .when(size == 0, "0")
        .otherwise(F.concat(sign, mantissa.cast("string"), F.lit("p"), power.cast("string")))
    )


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as text that does not depend on how an engine prints its type."""
    value, kind = F.col(name), df.schema[name].dataType.typeName()
    if kind in ("double", "float"):
        return _exact_double(value.cast("double"))
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(value.cast("timestamp")).cast("string")
    if kind == "date":
        return F.unix_date(value).cast("string")
    return value.cast("string")


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row: every cell with its length in bytes before it, NULL as a dash."""
    return _joined_digest([cell_text(df, name) for name in df.columns])


def _joined_digest(texts: list[Column]) -> Column:
    cells = []
    for text in texts:
        whole = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        cells.append(F.coalesce(whole, F.lit("-")))
    return F.sha2(F.concat(*cells), 256)


def content_hash(df: DataFrame) -> DataFrame:
    """Rows, columns and one SHA-256 of the content, whatever the order of the rows.

    The digests of the rows are summed in eight parts of 32 bits, so repeated rows count; the
    column names are in it. Any engine with SHA-256 can work it out again.
    """
    digests = _staged_texts(df).select(
        F.spark_partition_id().alias("_partition"),
        _joined_digest([F.col(f"_cell{i}") for i in range(len(df.columns))]).alias("_digest"),
    )
    # 16 digits are read as one signed number, whose halves are two of the parts.
    words = digests.select(
        "_partition",
        *[F.conv(F.substring("_digest", 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"_w{i}") for i in range(4)],
    )
    halves = [
        half
        for i in range(4)
        for half in (F.shiftrightunsigned(f"_w{i}", 32), F.col(f"_w{i}").bitwiseAND(F.lit(0xFFFFFFFF)))
    ]
    # The sums of one partition are whole numbers of 64 bits: they hold 2 ** 31 rows.
    partial = words.groupBy("_partition").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(h).alias(f"_s{i}") for i, h in enumerate(halves)]
    )
    rows = F.coalesce(F.sum("_rows"), F.lit(0))
    sums = [F.sum(F.col(f"_s{i}").cast("decimal(28,0)")) for i in range(8)]
    parts = [F.coalesce(s, F.lit(0)).cast("string") for s in sums]
    names = F.lit(",".join(df.columns))
    return partial.agg(
        rows.alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.sha2(F.concat_ws("|", names, rows.cast("string"), *parts), 256).alias("content_sha256"),
    )


def _staged_texts(df: DataFrame) -> DataFrame:
    """``cell_text`` of every column: _cell0, _cell1, ... in order.

    The exponents of doubles are found in selects of their own, so each is worked out once and not
    once a mention.
    """
    doubles = [
        i for i, f in enumerate(df.schema.fields) if f.dataType.typeName() in ("double", "float")
    ]
    cells = df.select(
        *[
            (F.col(c).cast("double") if i in doubles else cell_text(df, c)).alias(f"_cell{i}")
            for i, c in enumerate(df.columns)
        ]
    )
    if not doubles:
        return cells
    finite = {i: (F.abs(f"_cell{i}") > 0) & (F.abs(f"_cell{i}") < float("inf")) for i in doubles}
    for step in (_near_power, _not_above, _not_below):
        made = {f"_power{i}": F.when(finite[i], step(F.abs(f"_cell{i}"), f"_power{i}")) for i in doubles}
        cells = cells.withColumns(made)
    texts = {f"_cell{i}": _double_text(F.col(f"_cell{i}"), F.col(f"_power{i}")) for i in doubles}
    return cells.withColumns(texts)


def full_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows (NULLs equal)."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_out"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("full_duplicates"),
    )


def dataset_manifest(dataset: str, source: DataFrame, written: DataFrame, notes: str = ""):
    """One manifest row: rows in and out, columns, repeated rows, content hash, notes."""
    rows_in = source.agg(F.count(F.lit(1))).scalar()
    digest = content_hash(written).select("content_sha256").scalar()
    return full_duplicate_rows(written).select(
        F.lit(dataset).alias("dataset"),
        rows_in.alias("rows_in"),
        "rows_out",
        F.lit(len(written.columns)).cast("bigint").alias("columns"),
        "full_duplicates",
        digest.alias("content_sha256"),
        F.lit(notes).alias("notes"),
    )


def snapshot_id(metadata: DataFrame, source_snapshot: Column | None = None) -> DataFrame:
    """Content-addressed id of a snapshot, from one metadata row per dataset.

    The metadata has as many rows as the snapshot has datasets (ten here), which is what
    the single JSON document may hold. A derived snapshot carries its source's id.
    """
    entries = F.sort_array(F.collect_list(F.struct(*metadata.columns))).alias("datasets")
    parts = ["datasets"]
    if source_snapshot is not None:
        parts.append(source_snapshot.alias("source_snapshot_id"))
    document = F.to_json(F.struct(*parts))
    return metadata.agg(entries).select(F.sha2(document, 256).alias("snapshot_id"))


def reconcile_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Catalogued against expected row counts, one row per dataset of either side."""
    joined = actual.join(expected, "dataset", "full_outer")
    return joined.select(
        "dataset",
        "actual_rows",
        "expected_rows",
        F.when(F.col("actual_rows").eqNullSafe(F.col("expected_rows")), "PASS")
        .otherwise("FAIL")
        .alias("status"),
    )


def count_table(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Row counts of several tables, one row each."""
    parts = [
        df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(dataset).alias("dataset"), name)
        for dataset, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# ---- snapshots -------------------------------------------------------------------


def _completion_path(root: str, snapshot: str) -> str:
    return f"{root.rstrip('/')}/snapshots/{snapshot}/_completed"


def is_published(spark: SparkSession, root: str, snapshot: str) -> bool:
    try:
        return not spark.read.parquet(_completion_path(root, snapshot)).isEmpty()
    except AnalysisException:
        return False


def publish_snapshot(
    spark: SparkSession, root: str, snapshot: str, datasets: dict[str, DataFrame]
) -> DataFrame:
    """Write every dataset under a new snapshot path, then the completion manifest.

    A published snapshot is never written again; one without its manifest is invisible.
    """
    if is_published(spark, root, snapshot):
        raise FileExistsError(f"snapshot {snapshot} is already published")
    base = f"{root.rstrip('/')}/snapshots/{snapshot}"
    rows: DataFrame | None = None
    for name, df in datasets.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
        written = spark.read.schema(df.schema).parquet(f"{base}/{name}")
        row = content_hash(written).select(F.lit(name).alias("dataset"), "*")
        rows = row if rows is None else rows.unionByName(row)
    rows.write.mode("errorifexists").parquet(_completion_path(root, snapshot))
    return spark.read.parquet(_completion_path(root, snapshot))


def read_snapshot(spark: SparkSession, root: str, snapshot: str, dataset: str) -> DataFrame:
    if not is_published(spark, root, snapshot):
        raise FileNotFoundError(f"snapshot {snapshot} has no completion manifest")
    return spark.read.parquet(f"{root.rstrip('/')}/snapshots/{snapshot}/{dataset}")


# ---- files -----------------------------------------------------------------------


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, length and modification time; the content column is pruned from the scan."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )


def table_totals(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, columns and the exact total of one integer column, one row per table."""
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col(total).cast("decimal(38,0)")).cast("string").alias("total"),
        ).select(
            F.lit(name).alias("dataset"),
            "rows",
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            "total",
        )
        for name, (df, total) in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def table_integrity(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Measured tables against a stored manifest: missing, unexpected, or which figure differs."""
    f, m = found.alias("f"), manifest.alias("m")
    joined = f.join(m, F.col("f.dataset") == F.col("m.dataset"), "full_outer")

    def differs(name: str) -> Column:
        return ~F.col(f"f.{name}").eqNullSafe(F.col(f"m.{name}"))

    status = (
        F.when(F.col("f.dataset").isNull(), "MISSING")
        .when(F.col("m.dataset").isNull(), "UNEXPECTED")
        .when(differs("columns"), "COLUMN_MISMATCH")
        .when(differs("rows"), "ROW_MISMATCH")
        .when(differs("total"), "TOTAL_MISMATCH")
        .otherwise("PASS")
    )
    return joined.select(
        F.coalesce("f.dataset", "m.dataset").alias("dataset"),
        F.col("f.rows").alias("rows"),
        F.col("f.total").alias("total"),
        status.alias("status"),
    )
