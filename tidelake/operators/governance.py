"""Table governance: determinism, source gating, snapshots, isolation, query logs, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.joins import compare_manifests
from tidelake.session import small_table
from tidelake.sources.sinks import content_hash, list_files

# Codes of the source gate.
GATE_CODES = (
    "TABLE_UNAVAILABLE",
    "UNEXPECTED_TABLE_TYPE",
    "MISSING_LOCATION",
    "INVALID_LOCATION",
    "UNEXPECTED_BUCKET",
    "UNEXPECTED_PREFIX",
    "EMPTY_LOCATION",
)
LOCATION_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]+)/(.+)$"

# Seconds added on both sides of a run when its queries are looked up, and
# the state a query must end in.
QUERY_WINDOW_SECONDS = 60
SUCCEEDED = "SUCCEEDED"


def run_manifest(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and order-free content hash of each dataset of a run."""
    parts = [
        content_hash(df).select(F.lit(name).alias("dataset"), "*") for name, df in datasets.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Determinism of two runs: hash, rows and columns of every dataset."""
    return compare_manifests(
        first, second, "dataset", ["content_sha256", "row_count", "column_count"]
    )


def gate_sources(
    expected: DataFrame,
    catalog: DataFrame,
    table_type: str,
    bucket: str,
    prefix: str,
) -> DataFrame:
    """Expected sources against the catalog: PASS, or BLOCKED with the first violation.

    ``expected`` has (database_name, table_name); ``catalog`` adds table_type, location and
    first_object, the first non-empty object under the location.
    """
    keys = ["database_name", "table_name"]
    found = catalog.withColumn("_listed", F.lit(True))
    joined = expected.join(found, keys, "left")
    host = F.nullif(F.regexp_extract("location", LOCATION_PATTERN, 1), F.lit(""))
    path = F.nullif(F.regexp_extract("location", LOCATION_PATTERN, 2), F.lit(""))
    code = (
        F.when(F.col("_listed").isNull(), "TABLE_UNAVAILABLE")
        .when(~F.coalesce(F.col("table_type") == table_type, F.lit(False)), "UNEXPECTED_TABLE_TYPE")
        .when(F.coalesce(F.length("location"), F.lit(0)) == 0, "MISSING_LOCATION")
        .when(host.isNull() | path.isNull(), "INVALID_LOCATION")
        .when(host != bucket, "UNEXPECTED_BUCKET")
        .when(~F.startswith(path, F.lit(prefix)), "UNEXPECTED_PREFIX")
        .when(F.col("first_object").isNull(), "EMPTY_LOCATION")
    )
    return joined.select(
        *keys,
        F.when(code.isNull(), "PASS").otherwise("BLOCKED").alias("status"),
        code.alias("violation_code"),
    )


def gate_result(checks: DataFrame) -> DataFrame:
    blocked = F.count_if(F.col("status") == "BLOCKED")
    return checks.agg(
        F.count(F.lit(1)).alias("expected_count"),
        F.count_if(F.col("status") == "PASS").alias("available_count"),
        blocked.alias("blocked_count"),
        F.when(blocked == 0, "PASS").otherwise("BLOCKED").alias("status"),
    )


def table_states(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Table name, schema text and file listing digest of Parquet locations."""
    parts = []
    for name, path in tables.items():
        files = list_files(spark, path)
        entry = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
        schema = spark.read.parquet(path).schema.json()
        parts.append(
            files.agg(
                F.count(F.lit(1)).alias("files"),
                F.sum("length").alias("bytes"),
                F.bit_xor(entry).alias("listing_xor"),
            ).select(
                F.lit(name).alias("table_name"),
                F.sha2(F.lit(schema), 256).alias("schema_sha256"),
                "files",
                "bytes",
                "listing_xor",
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def compare_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables that changed, appeared or went between two states."""
    compared = compare_manifests(
        before, after, "table_name", ["schema_sha256", "files", "bytes", "listing_xor"]
    )
    return compared.select("table_name", (F.col("status") == "FAIL").alias("changed"))


def isolation_inventory(tables: DataFrame, expected: dict[str, int], root: str) -> DataFrame:
    """Table count per layer and locations outside the allowed root."""
    allowed = root.rstrip("/") + "/"
    inside = F.coalesce(F.startswith("location", F.lit(allowed)), F.lit(False))
    counted = tables.groupBy("layer").agg(
        F.count(F.lit(1)).alias("actual_table_count"),
        F.count_if(~inside).alias("bad_locations"),
    )
    wanted = small_table(
        tables.sparkSession,
        list(expected.items()), "layer string, expected_table_count bigint"
    )
    joined = wanted.join(counted, "layer", "full_outer").na.fill(
        0, ["expected_table_count", "actual_table_count", "bad_locations"]
    )
    good = (F.col("expected_table_count") == F.col("actual_table_count")) & (
        F.col("bad_locations") == 0
    )
    return joined.withColumn("status", F.when(good, "PASS").otherwise("FAIL"))


def attribute_queries(
    log: DataFrame, started: Column, completed: Column, markers: list[str]
) -> DataFrame:
    """Queries of a run: submitted around it, in a marked database or naming a marker."""
    window = F.make_dt_interval(secs=F.lit(QUERY_WINDOW_SECONDS))
    in_time = F.col("submitted_at").between(started - window, completed + window)
    marked = F.col("database").isin(*markers)
    for marker in markers:
        marked = marked | F.contains("query", F.lit(marker))
    return log.where(in_time & F.coalesce(marked, F.lit(False)))


def query_roll_up(attributed: DataFrame) -> DataFrame:
    """Totals of the attributed queries; none at all is a failure too."""
    failed = F.count_if(F.coalesce(F.col("state") != SUCCEEDED, F.lit(True)))
    total = F.count(F.lit(1))
    return attributed.agg(
        total.alias("query_count"),
        failed.alias("failed_query_count"),
        F.coalesce(F.sum("scanned_bytes"), F.lit(0)).alias("scanned_bytes"),
        F.coalesce(F.sum("engine_ms"), F.lit(0)).alias("engine_ms"),
        F.when((total > 0) & (failed == 0), "PASS").otherwise("FAIL").alias("status"),
    )


def sealed_records(records: DataFrame) -> DataFrame:
    """Evidence records with the SHA-256 of their JSON form."""
    return records.withColumn("sha256", F.sha2(F.to_json(F.struct(*records.columns)), 256))


def append_evidence(records: DataFrame, path: str) -> DataFrame:
    """Append sealed records and return the table read back."""
    sealed = sealed_records(records)
    sealed.write.mode("append").parquet(path)
    return records.sparkSession.read.schema(sealed.schema).parquet(path)


def checksum_manifest(sealed: DataFrame, *by: str) -> DataFrame:
    """Order-free checksum of the sealed records per group.

    The whole digests are summed, in eight parts of 32 bits, so repeats count.
    """
    parts = [
        F.sum(F.conv(F.substring("sha256", 8 * i + 1, 8), 16, 10).cast("decimal(28,0)"))
        for i in range(8)
    ]
    return sealed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.concat_ws(":", *[p.cast("string") for p in parts]).alias("checksum"),
    )


def broken_seals(sealed: DataFrame) -> DataFrame:
    """Records whose stored digest no longer matches their content."""
    content = [c for c in sealed.columns if c != "sha256"]
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return sealed.where(~F.col("sha256").eqNullSafe(digest))
