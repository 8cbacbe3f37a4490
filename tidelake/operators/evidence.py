"""Evidence collectors: schema, privacy, inventory, definitions, quality, freshness, runtime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.keys import SENSITIVE_NAME_PATTERN
from tidelake.operators.contracts import FORBIDDEN_PUBLIC_COLUMNS


def schema_differences(expected: DataFrame, current: DataFrame) -> DataFrame:
    """Positional comparison of column lists, long form: (model, side, column_name).

    Both inputs have (model, position, column_name). A dropped middle column reports every
    column that moved; each name is reported once per side.
    """
    e, c = expected.alias("e"), current.alias("c")
    joined = e.join(
        c,
        (F.col("e.model") == F.col("c.model")) & (F.col("e.position") == F.col("c.position")),
        "full_outer",
    ).where(~F.col("e.column_name").eqNullSafe(F.col("c.column_name")))
    sides = F.array(
        F.struct(F.lit("missing").alias("side"), F.col("e.column_name").alias("column_name")),
        F.struct(F.lit("unexpected").alias("side"), F.col("c.column_name").alias("column_name")),
    )
    return (
        joined.select(
            F.coalesce("e.model", "c.model").alias("model"), F.explode(sides).alias("d")
        )
        .select("model", "d.side", "d.column_name")
        .where(F.col("column_name").isNotNull())
        .distinct()
    )


def schema_evidence(expected: DataFrame, current: DataFrame) -> DataFrame:
    """Column counts and difference counts per model."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("model").agg(F.count(F.lit(1)).alias(name))

    differences = schema_differences(expected, current).groupBy("model").agg(
        F.count_if(F.col("side") == "missing").alias("missing_columns"),
        F.count_if(F.col("side") == "unexpected").alias("unexpected_columns"),
    )
    joined = counted(expected, "expected_column_count").join(
        counted(current, "actual_column_count"), "model", "full_outer"
    ).join(differences, "model", "left")
    return joined.na.fill(0)


def privacy_evidence(columns: DataFrame) -> DataFrame:
    """Forbidden columns of public models: exact name first, then the name pattern."""
    name = F.lower("column_name")
    found = name.isin(*FORBIDDEN_PUBLIC_COLUMNS) | F.regexp_like(
        name, F.lit(SENSITIVE_NAME_PATTERN)
    )
    return columns.where((F.col("exposure") == "public") & found).select(
        "model", "column_name"
    ).distinct()


def inventory_evidence(expected: DataFrame, found: DataFrame, required: list[str]) -> DataFrame:
    """Exact model set and presence of the required fields, one row."""
    e, f = expected.select("model").distinct(), found
    complete = F.lit(True)
    for field in required:
        complete = complete & F.col(field).isNotNull()
    fields = f.withColumn("_complete", complete)
    joined = e.alias("e").join(fields.alias("f"), F.col("e.model") == F.col("f.model"), "full_outer")
    wanted, present = F.col("e.model").isNotNull(), F.col("f.model").isNotNull()
    return joined.agg(
        F.count_if(wanted & present).alias("resource_count"),
        F.count_if(wanted & ~present).alias("missing_models"),
        F.count_if(present & ~wanted).alias("unexpected_models"),
        (
            (F.count_if(wanted & ~present) == 0)
            & (F.count_if(wanted & present & ~F.col("f._complete")) == 0)
        ).alias("required_fields_present"),
    )


def definition_changes(baseline: DataFrame, current: DataFrame, approved: DataFrame) -> DataFrame:
    """Changed, new and deleted definitions and whether each is an approved model."""
    b, c = baseline.alias("b"), current.alias("c")
    old, new = F.col("b.model"), F.col("c.model")
    changed = c.join(b, old == new, "full_outer").where(
        old.isNull()
        | new.isNull()
        | ~F.col("b.definition_sha256").eqNullSafe(F.col("c.definition_sha256"))
    )
    kind = F.when(old.isNull(), "added").when(new.isNull(), "deleted").otherwise("changed")
    names = changed.select(F.coalesce(new, old).alias("model"), kind.alias("change")).distinct()
    listed = approved.select(F.col("model").alias("approved_model")).distinct()
    return names.join(listed, names["model"] == listed["approved_model"], "left").select(
        "model", "change", F.col("approved_model").isNull().alias("unapproved")
    )


def quality_evidence(results: DataFrame, *by: str) -> DataFrame:
    """Test results rolled up: any test that did not pass fails the run."""
    tests = results.where(F.startswith("unique_id", F.lit("test.")))
    failed = ~F.coalesce(F.col("status") == "pass", F.lit(False))
    return tests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(failed).alias("failed_tests"),
        F.count_distinct(F.when(failed, F.col("unique_id"))).alias("failing_ids"),
        F.when(F.count_if(failed) > 0, "FAIL").otherwise("PASS").alias("status"),
    )


def failing_tests(results: DataFrame, *by: str) -> DataFrame:
    """The distinct failing tests, long form."""
    failed = ~F.coalesce(F.col("status") == "pass", F.lit(False))
    return (
        results.where(F.startswith("unique_id", F.lit("test.")) & failed)
        .select(*by, "unique_id")
        .distinct()
    )


def freshness_evidence(control: DataFrame, *by: str) -> DataFrame:
    """Age and status per dataset; unusable rows carry a reject reason instead.

    The age is deadline minus publication, never below zero, so a publication after the
    deadline has age 0; ``lateness_seconds`` keeps the signed value.
    """
    source = F.btrim("dataset_name")
    status = F.upper(F.btrim("freshness_status"))
    expected, actual = F.col("expected_publish_time"), F.col("actual_publish_time")
    slo = F.col("freshness_slo_hours")
    ahead = (
        F.unix_micros(expected.cast("timestamp")) - F.unix_micros(actual.cast("timestamp"))
    ) / F.lit(1e6)
    rows = control.withColumns(
        {"source": source, "_status": status, "observed_age_seconds": F.greatest(F.lit(0.0), ahead),
         "lateness_seconds": -ahead, "maximum_age_seconds": slo * 3600.0}
    )
    copies = rows.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    marked = rows.join(copies, [*by, "source"], "left")
    reject = (
        F.when(F.coalesce(F.length("source"), F.lit(0)) == 0, "empty dataset_name")
        .when(F.col("_copies") > 1, "duplicate dataset")
        .when(~F.coalesce(F.col("_status").isin("PASS", "FAIL"), F.lit(False)), "bad status")
        .when(expected.isNull() | actual.isNull(), "bad timestamp")
        .when(slo.isNull(), "slo not numeric")
        .when(slo < 0, "slo negative")
    )
    over = F.col("observed_age_seconds") > F.col("maximum_age_seconds")
    fail = (F.col("_status") == "FAIL") | over
    usable = reject.isNull()

    def if_usable(value: Column) -> Column:
        return F.when(usable, value)

    return marked.select(
        *by,
        "source",
        if_usable(F.col("observed_age_seconds")).alias("observed_age_seconds"),
        if_usable(F.col("maximum_age_seconds")).alias("maximum_age_seconds"),
        if_usable(F.col("lateness_seconds")).alias("lateness_seconds"),
        if_usable(F.when(fail, "FAIL").otherwise("PASS")).alias("status"),
        reject.alias("reject_reason"),
    )


def runtime_evidence(
    pipeline: DataFrame, canonical: DataFrame, inventory: DataFrame, queries: DataFrame, key: str
) -> DataFrame:
    """Four run inputs merged by run; a run that lacks one has a reject reason and FAIL."""
    sides = {"pipeline": pipeline, "canonical": canonical, "inventory": inventory, "queries": queries}
    joined = None
    for name, side in sides.items():
        side = side.withColumn(f"_has_{name}", F.lit(True))
        joined = side if joined is None else joined.join(side, key, "full_outer")
    lacking = F.concat_ws(
        ", ", *[F.when(F.col(f"_has_{n}").isNull(), F.lit(n)) for n in sides]
    )
    passed = (F.col("pipeline_result") == "PASS") & F.col("pipeline_success")
    unchanged = (F.col("canonical_result") == "PASS") & ~F.col("canonical_changed")
    return joined.select(
        key,
        F.when(F.coalesce(passed, F.lit(False)) & (lacking == ""), "PASS")
        .otherwise("FAIL")
        .alias("pipeline_status"),
        F.coalesce(unchanged, F.lit(False)).alias("canonical_unchanged"),
        F.col("total_tables").alias("isolated_output_tables"),
        F.col("failed_query_count").alias("athena_failed_queries"),
        F.when(lacking != "", F.concat(F.lit("missing "), lacking)).alias("reject_reason"),
    )


def assemble_inputs(
    identity: DataFrame, pre: DataFrame, post: DataFrame, key: str, sections: list[str]
) -> DataFrame:
    """Policy inputs from the evidence tables of a run, with the sections it lacks.

    Every side has one row per run and is shuffled once on the key; the three joins share
    that partitioning.
    """
    joined = identity.join(pre, key, "left").join(post, key, "left")
    wanted = F.array(*[F.lit(s) for s in sections])
    present = F.array_compact(
        F.array(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in sections if s in joined.columns])
    )
    extra = [c for c in joined.columns if c not in {*identity.columns, *sections}]
    unexpected = F.array_compact(
        F.array(F.lit(None).cast("string"), *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in extra])
    )
    return joined.withColumns(
        {
            "missing_sections": F.array_except(wanted, present),
            "unexpected_sections": unexpected,
        }
    )
