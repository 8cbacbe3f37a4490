"""Data-quality checks. Every check becomes one row of the long result table.

A dataset's counters are computed in one aggregate (plus one per key or duplicate test,
which need a grouping), and the single counter row is then unpivoted.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import keys
from tidelake.functions.scalar import rounded_ratio
from tidelake.operators.joins import Edge, orphans, without_parent
from tidelake.session import small_table
from tidelake.sources.sinks import row_hashes

# Tolerances of the reconciliation checks.
ROW_TOLERANCE = 0.02
TOTAL_TOLERANCE = 1e-6
REVENUE_TOLERANCE = 5.0
SHARE_TOLERANCE = 0.1


@dataclass(frozen=True)
class Check:
    """``observed`` is an aggregate; ``passed`` is a condition on its value ``{v}``."""

    name: str
    observed: Column
    expected: str = "0"
    passed: str = "{v} = 0"
    severity: str = "critical"
    details: str = ""


def violations(name: str, condition: Column, **rest) -> Check:
    """Check that counts the rows where ``condition`` holds and wants none."""
    return Check(name, F.count_if(condition), **rest)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _result(dataset: str, check: Check, value: str) -> str:
    texts = (dataset, check.name, check.severity, check.expected, check.details)
    name, check_name, severity, expected, details = map(_quoted, texts)
    return (
        f"struct({name} dataset, {check_name} check_name,"
        f" if(coalesce({check.passed.format(v=value)}, false), 'PASS', 'FAIL') status,"
        f" {severity} severity, cast({value} as string) observed_value,"
        f" {expected} expected_value, {details} details)"
    )


def run_checks(df: DataFrame, dataset: str, checks: list[Check]) -> DataFrame:
    """All checks of one dataset from one pass over it."""
    if not checks:
        raise ValueError(f"{dataset}: no checks given")
    counters = df.agg(*[c.observed.alias(f"c{i}") for i, c in enumerate(checks)])
    rows = ", ".join(_result(dataset, c, f"c{i}") for i, c in enumerate(checks))
    return counters.selectExpr(f"inline(array({rows}))")


def measure(df: DataFrame, checks: list[Check]) -> dict[str, Any]:
    """Values of the checks' aggregates, from one pass over the dataset."""
    return df.agg(*[c.observed.alias(c.name) for c in checks]).first().asDict()


def known_results(
    spark: SparkSession, results: list[tuple[str, Check, Any]]
) -> DataFrame:
    """Results of checks (dataset, check, value) that are already measured: no scan at all."""
    rows = ", ".join(_result(dataset, check, _literal(v)) for dataset, check, v in results)
    return spark.sql(f"select inline(array({rows}))")


def _literal(value: Any) -> str:
    if value is None:
        return "cast(null as bigint)"
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    return f"{value}L" if isinstance(value, int) else f"{value!r}D"


def unique_rows_and_keys(
    datasets: dict[str, tuple[DataFrame, list[str]]], whole_rows: bool = True
) -> DataFrame:
    """Repeated keys, and repeated whole rows, of several datasets in one grouping.

    A row goes into the shuffle as hashes of its key and of all its cells (128 bits each), so free
    text stays where it is. Equal rows are counted first, on the map side too; the keys' counts
    come from these.
    """
    parts = []
    for name, (df, key) in datasets.items():
        hashes = row_hashes(df.select(*key)) + (row_hashes(df) if whole_rows else [])
        columns = [h.alias(f"_h{i}") for i, h in enumerate(hashes)]
        parts.append(df.select(F.lit(name).alias("dataset"), *columns))
    every = union_all(parts)
    copies = every.groupBy(*every.columns).agg(F.count(F.lit(1)).alias("_n"))
    by_key = copies.groupBy("dataset", "_h0", "_h1").agg(
        F.sum("_n").alias("_rows"), F.sum(F.col("_n") - 1).alias("_extra")
    )
    repeated = F.sum(F.when(F.col("_rows") > 1, F.col("_rows")).otherwise(F.lit(0)))
    counted = by_key.groupBy("dataset").agg(
        F.sum("_extra").alias("no_full_duplicate_rows"), repeated.alias("primary_key_unique")
    )
    names = ["no_full_duplicate_rows", "primary_key_unique"][0 if whole_rows else 1 :]
    return counts_as_results(counted, list(datasets), names)


def declared_tests(
    tables: dict[str, DataFrame], tests: dict[str, dict[str, bool]]
) -> DataFrame:
    """Results of declared column tests: values that are NULL, and values that occur repeatedly.

    All columns of all datasets go into one grouping: each dataset is read once, its rows give
    their value under every tested column (as GROUPING SETS over these columns would), and equal
    values are counted on the map side first.
    """
    parts = []
    for name, columns in tests.items():
        cells = [
            F.struct(F.lit(f"{name}/{c}").alias("test"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
        parts.append(tables[name].select(F.inline(F.array(*cells))))
    values = union_all(parts).groupBy("test", "value").agg(F.count(F.lit(1)).alias("n"))
    nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    repeats = F.count_if(F.col("value").isNotNull() & (F.col("n") > 1))
    found = values.groupBy("test").agg(nulls.alias("not_null"), repeats.alias("unique"))
    wanted = [
        (name, f"{c}_{kind}", f"{name}/{c}", kind)
        for name, columns in tests.items()
        for c, once in columns.items()
        for kind in (("not_null", "unique") if once else ("not_null",))
    ]
    declared = small_table(
        values.sparkSession, wanted, "dataset string, check_name string, test string, kind string"
    )
    counted = found.unpivot("test", ["not_null", "unique"], "kind", "_found")
    value = F.coalesce("_found", F.lit(0))
    return declared.join(counted, ["test", "kind"], "left").select(
        "dataset",
        "check_name",
        F.when(value == 0, "PASS").otherwise("FAIL").alias("status"),
        F.lit("critical").alias("severity"),
        value.cast("bigint").cast("string").alias("observed_value"),
        F.lit("0").alias("expected_value"),
        F.lit("").alias("details"),
    )


def counts_as_results(counted: DataFrame, datasets: list[str], names: list[str]) -> DataFrame:
    """One result per dataset and count column, all wanted 0; an empty dataset has none wrong."""
    wanted = small_table(
        counted.sparkSession,
        [(d, n) for d in datasets for n in names],
        "dataset string, check_name string",
    )
    found = counted.unpivot("dataset", names, "check_name", "_found")
    value = F.coalesce("_found", F.lit(0))
    return wanted.join(found, ["dataset", "check_name"], "left").select(
        "dataset",
        "check_name",
        F.when(value == 0, "PASS").otherwise("FAIL").alias("status"),
        F.lit("critical").alias("severity"),
        value.cast("bigint").cast("string").alias("observed_value"),
        F.lit("0").alias("expected_value"),
        F.lit("").alias("details"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---- structure -------------------------------------------------------------------


def listed(values: list[str]) -> str:
    return ", ".join(values) if values else "none"


def metadata_checks(
    df: DataFrame, dataset: str, results: list[tuple[str, bool, str, str, str]]
) -> DataFrame:
    """Results already known from the schema: (name, passed, observed, expected, details)."""
    return metadata_table(df.sparkSession, [(dataset, *result) for result in results])


def metadata_table(spark: SparkSession, results: list[tuple]) -> DataFrame:
    """Results (dataset, name, passed, observed, expected, details) as one literal table."""
    rows = [
        (dataset, name, "PASS" if passed else "FAIL", "critical", observed, expected, details)
        for dataset, name, passed, observed, expected, details in results
    ]
    return small_table(
        spark,
        rows,
        "dataset string, check_name string, status string, severity string,"
        " observed_value string, expected_value string, details string",
    )


def required_columns(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    return required_columns_of({dataset: (df, columns)})


def required_columns_of(datasets: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Presence of the required columns of several datasets, as one literal table."""
    rows = []
    for dataset, (df, columns) in datasets.items():
        missing = [c for c in columns if c not in df.columns]
        rows.append(
            (dataset, "required_columns_present", not missing, listed(missing), "none missing", "")
        )
    return metadata_table(next(iter(datasets.values()))[0].sparkSession, rows)


def exact_columns(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    return exact_columns_of({dataset: (df, columns)})


def exact_columns_of(datasets: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Names and order of the columns of several datasets, as one literal table."""
    rows = [
        (dataset, "exact_ordered_columns", df.columns == columns, listed(df.columns),
         listed(columns), "")
        for dataset, (df, columns) in datasets.items()
    ]
    return metadata_table(next(iter(datasets.values()))[0].sparkSession, rows)


# ---- row counters ----------------------------------------------------------------


def not_empty() -> Check:
    return Check("dataset_not_empty", F.count(F.lit(1)), "> 0", "{v} > 0")


def key_not_null(key: list[str]) -> Check:
    return violations("primary_key_not_null", reduce(or_, [F.col(k).isNull() for k in key]))


def no_null_cells(df: DataFrame) -> Check:
    cells = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return Check("no_null_cells", cells)


def non_negative(columns: list[str]) -> list[Check]:
    return [violations(f"{c}_non_negative", F.col(c) < 0) for c in columns]


def within(name: str, column: str, low: float, high: float) -> Check:
    """NULL counts as outside."""
    inside = F.coalesce(F.col(column).between(low, high), F.lit(False))
    return violations(name, ~inside)


def components_reconcile(total: str) -> Check:
    gap = F.abs(F.col("product_revenue") + F.col("freight_revenue") - F.col(total))
    return violations("revenue_components_reconcile", gap > ROW_TOLERANCE)


def average_correct(top: str, bottom: str, average: str) -> Check:
    expected = F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))
    return violations(f"{average}_correct", F.abs(expected - F.col(average)) > ROW_TOLERANCE)


def valid_date(column: str) -> Check:
    parsed = F.try_to_date(F.col(column).cast("string"), "yyyy-MM-dd")
    return violations(f"{column}_valid_date", parsed.isNull())


def not_above(name: str, smaller: str, larger: str) -> Check:
    return violations(name, F.col(smaller) > F.col(larger))


def sums_to_hundred(name: str, column: str) -> Check:
    total = F.round(F.sum(F.col(column).cast("decimal(18,4)")), 4)
    return Check(name, total, "100.0", f"abs({{v}} - 100) <= {SHARE_TOLERANCE}")


# ---- grouped counters ------------------------------------------------------------


def duplicate_key_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Number of rows whose key occurs more than once (all of them, not the repeats)."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("key_rows"))


def key_unique(df: DataFrame, dataset: str, key: list[str]) -> DataFrame:
    counted = duplicate_key_rows(df, key)
    return run_checks(counted, dataset, [Check("primary_key_unique", F.max("key_rows"))])


def no_full_duplicates(df: DataFrame, dataset: str) -> DataFrame:
    copies = df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("extra"))
    total = F.coalesce(F.sum("extra"), F.lit(0))
    return run_checks(copies, dataset, [Check("no_full_duplicate_rows", total)])


def foreign_key(
    child: DataFrame, dataset: str, name: str, key: str, parent: DataFrame, parent_key: str
) -> DataFrame:
    lost = orphans(child.select(key), key, parent, parent_key)
    return run_checks(lost, dataset, [Check(name, F.count(F.lit(1)))])


def orphan_results(found: DataFrame, edges: list[Edge]) -> DataFrame:
    """One result per edge from its ``edge_keys``: the children without a parent.

    Edges are named ``dataset/check``.
    """
    lost = F.sum(F.when(without_parent(), F.col("children")).otherwise(F.lit(0)))
    counted = found.groupBy("edge").agg(lost.alias("_found"))
    split = F.split("edge", "/")
    named = [tuple(e.name.split("/")) for e in edges]
    wanted = small_table(found.sparkSession, named, "dataset string, check_name string")
    counted = counted.select(split[0].alias("dataset"), split[1].alias("check_name"), "_found")
    value = F.coalesce("_found", F.lit(0))
    return wanted.join(counted, ["dataset", "check_name"], "left").select(
        "dataset",
        "check_name",
        F.when(value == 0, "PASS").otherwise("FAIL").alias("status"),
        F.lit("critical").alias("severity"),
        value.cast("string").alias("observed_value"),
        F.lit("0").alias("expected_value"),
        F.lit("").alias("details"),
    )


def covered(found: DataFrame, edge: Edge) -> DataFrame:
    """Distinct keys of the edge's child per 100 distinct keys of its parent; must be 100.0."""
    dataset, name = edge.name.split("/")
    own = found.where(F.col("edge") == edge.name)
    parts = F.count_if(F.col("key").isNotNull() & (F.col("children") > 0))
    whole = F.count_if(F.col("key").isNotNull() & (F.col("parents") > 0))
    share = rounded_ratio(parts * 100, whole, 4)
    return run_checks(own, dataset, [Check(name, share, "100.0", "{v} = 100.0")])


def coverage(
    part: DataFrame, whole: DataFrame, dataset: str, name: str, key: str
) -> DataFrame:
    """Distinct keys of ``part`` per 100 distinct keys of ``whole``; must be 100.0000."""
    whole_keys = whole.agg(F.count_distinct(key)).scalar()
    counts = part.agg(F.count_distinct(key).alias("part_keys")).withColumn("whole_keys", whole_keys)
    share = F.max(rounded_ratio(F.col("part_keys") * 100, F.col("whole_keys"), 4))
    check = Check(name, share, "100.0", "{v} = 100.0")
    return run_checks(counts, dataset, [check])


# ---- text ------------------------------------------------------------------------


def pii_like_checks(columns: list[str]) -> list[Check]:
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return [
        violations("no_email_like_values", keys.looks_like_email(text)),
        violations("no_phone_like_values", keys.looks_like_phone(text)),
    ]


def pii_like_rows(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    return run_checks(df, dataset, pii_like_checks(columns))


# ---- roll-up ---------------------------------------------------------------------


def roll_up(results: DataFrame, *by: str) -> DataFrame:
    """Totals and the overall status: PASS exactly when no critical check failed."""
    failed = F.col("status") == "FAIL"
    critical = failed & (F.col("severity") == "critical")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("status") == "PASS").alias("passed_checks"),
        F.count_if(failed).alias("failed_checks"),
        F.count_if(critical).alias("critical_failures"),
        F.when(F.count_if(critical) == 0, "PASS").otherwise("FAIL").alias("overall_status"),
    )
