"""Raw readers: CSV, JSON lines, catalog views, schemas and evidence documents."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.session import small_table, written
from tidelake.sources import csv_split
from tidelake.sources.schemas import RAW_COLUMNS, RUN_RESULT_SCHEMA, raw_schema

CORRUPT = "_malformed"


def read_raw_csv(
    spark: SparkSession, path: str, table: str, corrupt_column: str | None = None
) -> DataFrame:
    """Raw CSV with a header, as text. A missing path fails when the frame is built.

    A file is read by as many tasks as it has splits, also where quoted fields hold line breaks.
    Every file's header must name the columns of the table in order.
    """
    found = csv_split.records(spark, path)
    _check_headers(found.where("header"), table)
    schema = raw_schema(table, corrupt_column)
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    if corrupt_column:
        options["columnNameOfCorruptRecord"] = corrupt_column
    fields = F.from_csv("text", F.lit(_ddl(schema)), options)
    return found.where(~F.col("header")).select(fields.alias("f")).select("f.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _check_headers(headers: DataFrame, table: str) -> None:
    """Refuse a file whose first record is not the list of the table's columns."""
    columns = RAW_COLUMNS[table]
    # One place more than there are columns, for a header that is too long.
    places = ", ".join(f"c{i} string" for i in range(len(columns) + 1))
    named = F.from_csv(F.regexp_replace("text", "^\ufeff", ""), F.lit(places), {"escape": '"'})
    wanted = F.struct(
        *[F.lit(c).alias(f"c{i}") for i, c in enumerate(columns)],
        F.lit(None).cast("string").alias(f"c{len(columns)}"),
    )
    wrong = headers.where(~named.eqNullSafe(wanted)).select("text").distinct().take(3)
    if wrong:
        raise ValueError(f"{table}: header {[r['text'] for r in wrong]} is not {columns}")


def _any(df: DataFrame, columns: list[str], test) -> Column:
    return reduce(or_, [F.coalesce(test(F.col(c)), F.lit(False)) for c in columns])


def csv_conversion_report(raw: DataFrame, table: str) -> DataFrame:
    """Records, malformed records, records with a NUL and records with a line break."""
    columns = RAW_COLUMNS[table]

    def breaks(c: Column) -> Column:
        return F.contains(c, F.lit("\r")) | F.contains(c, F.lit("\n"))

    return raw.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col(CORRUPT).isNotNull()).alias("wrong_arity"),
        F.count_if(_any(raw, columns, lambda c: F.contains(c, F.lit("\0")))).alias("with_nul"),
        F.count_if(_any(raw, columns, breaks)).alias("with_line_break"),
    )


def json_lines(raw: DataFrame, table: str) -> DataFrame:
    """One JSON object per record, keys in schema order, an empty field as empty text."""
    fields = []
    for field in raw_schema(table).fields:
        value = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            value = F.coalesce(value, F.lit(""))
        fields.append(value.alias(field.name))
    return raw.select(F.to_json(F.struct(*fields)).alias("value"))


def convert_csv_to_json_lines(
    spark: SparkSession, csv_path: str, out_path: str, table: str
) -> DataFrame:
    """Write the JSON-lines copy of a raw CSV; refuses malformed input of any file."""
    raw = read_raw_csv(spark, csv_path, table, corrupt_column=CORRUPT)
    report = written(csv_conversion_report(raw, table), "conversion")
    totals = report.first()
    if totals["wrong_arity"] or totals["with_nul"]:
        raise ValueError(f"{csv_path}: {totals.asDict()}")
    json_lines(raw, table).write.mode("errorifexists").text(out_path)
    return report


def read_json_lines(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(raw_schema(table)).json(path)


def json_shape_report(
    spark: SparkSession, path: str, table: str, expected_rows: int | None = None
) -> DataFrame:
    """Shape violations of a JSON-lines table: key order, value types and row count."""
    fields = raw_schema(table).fields
    order = F.array(*[F.lit(f.name) for f in fields])
    kinds = ", ".join(
        f"{f.name}: {'BOOLEAN' if isinstance(f.dataType, T.BooleanType) else 'STRING'}"
        for f in sorted(fields, key=lambda f: f.name)
    )
    lines = spark.read.text(path)
    shape = F.schema_of_variant(F.try_parse_json("value"))
    rows = F.count(F.lit(1))
    wanted = rows if expected_rows is None else F.lit(expected_rows)
    return lines.agg(
        rows.alias("row_count"),
        F.count_if(~F.coalesce(F.json_object_keys("value") == order, F.lit(False))).alias(
            "key_order_violations"
        ),
        F.count_if(~F.coalesce(shape == f"OBJECT<{kinds}>", F.lit(False))).alias(
            "value_type_violations"
        ),
        F.abs(rows - wanted).alias("row_count_difference"),
    )


def register_catalog_table(spark: SparkSession, name: str, path: str, table: str) -> DataFrame:
    """Expose a JSON-lines location under a catalog name, with the fixed schema."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw_schema(table).fields)
    spark.sql(
        f"create or replace temporary view {name} ({columns}) using json options (path '{path}')"
    )
    return spark.table(name)


def schema_table(spark: SparkSession, zones: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Columns of the datasets as rows; one row per column, so small by construction."""
    rows = [
        (zone, name, position, field.name, field.dataType.simpleString())
        for zone, datasets in zones.items()
        for name, df in datasets.items()
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    return small_table(
        spark,
        rows,
        "table_schema string, table_name string, ordinal_position int, column_name string,"
        " data_type string",
    )


def read_run_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Test and model results of run documents, one row per result."""
    documents = (
        spark.read.schema(RUN_RESULT_SCHEMA).option("multiLine", multi_line).json(path)
    )
    return documents.select(F.explode("results").alias("r")).select("r.*")


def load_contract(text: str) -> dict[str, Any]:
    """One contract document. YAML is optional in the environment, so import on use."""
    import yaml

    contract = yaml.safe_load(text)
    if not isinstance(contract, dict):
        raise ValueError("a contract must be a mapping")
    return contract
