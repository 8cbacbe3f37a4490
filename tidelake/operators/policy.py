"""Release policies evaluated over evidence tables.

One row holds the evidence of one (run, stage). A rule is an expression over that row that
yields an array of violations, so evaluation is a projection: no shuffle, any number of
runs. A condition over missing evidence does not hold, and a violation that would quote a
missing value is not raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The policy catalog, one tuple per policy:
# (policy_id, category, title, severity, evaluation stages).
POLICY_CATALOG = [
    ("PAC-META-001", "metadata", "Required governance metadata", "deny", ["pre", "post"]),
    ("PAC-SCHEMA-001", "schema_contract", "Governed Gold schema compatibility", "deny", ["pre"]),
    ("PAC-PRIVACY-001", "schema_contract", "Public Gold privacy boundary", "deny", ["pre", "post"]),
    (
        "PAC-TRANSFORM-001",
        "transformation_definition",
        "Governed transformation definition",
        "deny",
        ["pre"],
    ),
    ("PAC-RELEASE-001", "release_rule", "Release promotion decision", "deny", ["pre", "post"]),
    (
        "PAC-QUALITY-001",
        "runtime_validation",
        "Critical data-quality outcome",
        "deny",
        ["post"],
    ),
    ("PAC-FRESH-001", "runtime_validation", "Freshness threshold", "deny", ["post"]),
    ("PAC-RUNTIME-001", "runtime_validation", "Runtime execution integrity", "deny", ["post"]),
]
EXPECTED_OUTPUT_TABLES = 15

SECTIONS = [
    "experiment",
    "controls",
    "git",
    "release",
    "metadata",
    "schema_contract",
    "transformation",
    "privacy",
    "quality",
    "freshness",
    "runtime",
]

VIOLATION_TYPE = (
    "array<struct<policy_id:string,reason:string,details:string,category:string,severity:string>>"
)


# Policy ids, categories and the sentences of the reasons, here and below.


def _violation(policy_id: str, category: str, reason: Column, **details: Column) -> Column:
    extra = [details[k].alias(k) for k in sorted(details)]
    document = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
    return F.struct(
        F.lit(policy_id).alias("policy_id"),
        reason.alias("reason"),
        document.alias("details"),
        F.lit(category).alias("category"),
        F.lit("deny").alias("severity"),
    )


def _empty() -> Column:
    return F.array().cast(VIOLATION_TYPE)


def _raised(*branches: tuple[Column, Column]) -> Column:
    """Violations of the branches whose condition is true (not false, not unknown)."""
    return F.concat(
        *[F.when(c, F.array(v).cast(VIOLATION_TYPE)).otherwise(_empty()) for c, v in branches]
    )


def _or_empty(violations: Column) -> Column:
    return F.coalesce(violations.cast(VIOLATION_TYPE), _empty())


def _list_text(values: Column) -> Column:
    inner = F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")
    return F.concat(F.lit("["), inner, F.lit("]"))


def _number_text(value: Column) -> Column:
    """Number as short text: no trailing zeros."""
    return F.regexp_replace(value.cast("decimal(18,3)").cast("string"), r"\.?0+$", "")


def _known(*values: Column) -> Column:
    known = F.lit(True)
    for value in values:
        known = known & value.isNotNull()
    return known


def _stage_is(stage: str) -> Column:
    return F.col("evaluation_stage") == stage


def metadata_rule() -> Column:
    def missing(value: str) -> Column:
        return ~F.coalesce(F.length(value) > 0, F.lit(False))

    def violation(reason: str) -> Column:
        return _violation("PAC-META-001", "metadata", F.lit(reason))

    return _raised(
        (missing("git.branch"), violation("git branch is missing or empty")),
        (missing("git.commit"), violation("git commit is missing or empty")),
        (missing("experiment.run_key"), violation("experiment run key is missing or empty")),
        (
            F.col("metadata.required_fields_present") == F.lit(False),
            violation("required governance metadata is incomplete"),
        ),
        (
            F.col("metadata.resource_count") <= 0,
            violation("governed resource inventory is empty"),
        ),
    )


def schema_rule() -> Column:
    prefix = F.lit("governed Gold model ")

    def of_model(model: Column) -> Column:
        def listed(column: str, text: str) -> tuple[Column, Column]:
            reason = F.concat(
                prefix, model["model"], F.lit(f" {text}: "), _list_text(model[column])
            )
            return (
                F.size(model[column]) > 0,
                _violation("PAC-SCHEMA-001", "schema_contract", reason, model=model["model"]),
            )

        wanted, found = model["expected_column_count"], model["actual_column_count"]
        counts = F.concat(
            prefix,
            model["model"],
            F.lit(" column count mismatch: expected "),
            wanted.cast("string"),
            F.lit(", actual "),
            found.cast("string"),
        )
        return _raised(
            listed("missing_columns", "is missing required columns"),
            listed("unexpected_columns", "contains unexpected contract columns"),
            listed("incompatible_type_changes", "contains incompatible type changes"),
            (
                wanted != found,
                _violation("PAC-SCHEMA-001", "schema_contract", counts, model=model["model"]),
            ),
        )

    return F.flatten(F.transform("schema_contract.governed_models", of_model))


def privacy_rule() -> Column:
    found, public = F.col("privacy.detected_forbidden_columns"), F.col("privacy.public_models")
    reason = F.concat(
        F.lit("public Gold output contains governed forbidden columns: "), _list_text(found)
    )
    return _raised(
        (
            (F.size(found) > 0) & _known(public),
            _violation(
                "PAC-PRIVACY-001",
                "schema_contract",
                reason,
                public_models=public,
                detected_forbidden_columns=found,
            ),
        )
    )


def transformation_rule() -> Column:
    section = {
        name: F.col(f"transformation.{name}")
        for name in ("changed_models", "unapproved_definitions", "manifest_sha256")
    }
    unapproved = section["unapproved_definitions"]
    reason = F.concat(
        F.lit("unapproved or out-of-scope governed transformation definitions detected: "),
        _list_text(unapproved),
    )
    return _raised(
        (
            _stage_is("pre") & (F.size(unapproved) > 0) & _known(*section.values()),
            _violation("PAC-TRANSFORM-001", "transformation_definition", reason, **section),
        )
    )


def quality_rule() -> Column:
    section = {
        "quality_status": F.col("quality.status"),
        "total_tests": F.col("quality.total_tests"),
        "failed_tests": F.col("quality.failed_tests"),
        "critical_failures": F.col("quality.critical_failures"),
    }
    reason = F.concat(
        F.lit("critical data-quality validation failed: failed_tests="),
        section["failed_tests"].cast("string"),
        F.lit(" critical_failures="),
        _list_text(section["critical_failures"]),
    )
    return _raised(
        (
            _stage_is("post") & (F.col("quality.status") == "FAIL") & _known(*section.values()),
            _violation("PAC-QUALITY-001", "runtime_validation", reason, **section),
        )
    )


def source_failed(source: Column) -> Column:
    too_old = source["observed_age_seconds"] > source["maximum_age_seconds"]
    return F.coalesce(source["status"] == "FAIL", F.lit(False)) | F.coalesce(too_old, F.lit(False))


def freshness_rule() -> Column:
    sources = F.col("freshness.sources")

    def of_source(source: Column) -> Column:
        age, limit = source["observed_age_seconds"], source["maximum_age_seconds"]
        reason = F.concat(
            F.lit("freshness threshold breached for "),
            source["source"],
            F.lit(": observed_age_seconds="),
            _number_text(age),
            F.lit(" maximum_age_seconds="),
            _number_text(limit),
            F.lit(" status="),
            source["status"],
        )
        return _violation(
            "PAC-FRESH-001",
            "runtime_validation",
            reason,
            source=source["source"],
            observed_age_seconds=age,
            maximum_age_seconds=limit,
            source_status=source["status"],
        )

    def quoted(source: Column) -> Column:
        return source_failed(source) & _known(
            source["source"],
            source["observed_age_seconds"],
            source["maximum_age_seconds"],
            source["status"],
        )

    breached = F.transform(F.filter(sources, quoted), of_source)
    aggregate = _violation(
        "PAC-FRESH-001",
        "runtime_validation",
        F.lit("freshness evaluation failed without a source-level freshness failure record"),
        source=F.lit("__aggregate__"),
        observed_age_seconds=F.lit(0.0),
        maximum_age_seconds=F.lit(0.0),
        source_status=F.lit("FAIL"),
    )
    unexplained = (F.col("freshness.status") == "FAIL") & ~F.coalesce(
        F.exists(sources, source_failed), F.lit(False)
    )
    post = _or_empty(F.when(_stage_is("post"), breached))
    return F.concat(post, _or_empty(_raised((_stage_is("post") & unexplained, aggregate))))


def runtime_rule(expected_tables: int = EXPECTED_OUTPUT_TABLES) -> Column:
    section = {
        "pipeline_status": F.col("runtime.pipeline_status"),
        "canonical_unchanged": F.col("runtime.canonical_unchanged"),
        "isolated_output_tables": F.col("runtime.isolated_output_tables"),
        "athena_failed_queries": F.col("runtime.athena_failed_queries"),
    }
    failed = (
        (section["pipeline_status"] != "PASS")
        | ~section["canonical_unchanged"]
        | (section["isolated_output_tables"] != expected_tables)
        | (section["athena_failed_queries"] > 0)
    )
    reason = F.concat(
        F.lit("runtime execution integrity failed: pipeline_status="),
        section["pipeline_status"],
        F.lit(" canonical_unchanged="),
        section["canonical_unchanged"].cast("string"),
        F.lit(" isolated_output_tables="),
        section["isolated_output_tables"].cast("string"),
        F.lit(f" expected_isolated_output_tables={expected_tables} athena_failed_queries="),
        section["athena_failed_queries"].cast("string"),
    )
    return _raised(
        (
            _stage_is("post") & failed & _known(*section.values()),
            _violation(
                "PAC-RUNTIME-001",
                "runtime_validation",
                reason,
                expected_isolated_output_tables=F.lit(expected_tables),
                **section,
            ),
        )
    )


RULES = {
    "PAC-META-001": metadata_rule,
    "PAC-SCHEMA-001": schema_rule,
    "PAC-PRIVACY-001": privacy_rule,
    "PAC-TRANSFORM-001": transformation_rule,
    "PAC-QUALITY-001": quality_rule,
    "PAC-FRESH-001": freshness_rule,
    "PAC-RUNTIME-001": runtime_rule,
}


def release_rule(blocking: str) -> Column:
    violation = _violation(
        "PAC-RELEASE-001",
        "release_rule",
        F.lit("promotion requested while blocking policy violations remain unresolved"),
    )
    return _raised((F.col("release.promotion_requested") & (F.size(blocking) > 0), violation))


def apply_rule(inputs: DataFrame, policy_id: str) -> DataFrame:
    """Evidence rows with the violations of one blocking policy."""
    violations = F.sort_array(F.array_distinct(_or_empty(RULES[policy_id]())))
    return inputs.withColumn("violations", violations)


def evaluate(inputs: DataFrame, expected_tables: int = EXPECTED_OUTPUT_TABLES) -> DataFrame:
    """Evidence rows with their set of violations, in a total order."""
    settings = {"PAC-RUNTIME-001": (expected_tables,)}
    blocking = F.concat(*[_or_empty(rule(*settings.get(p, ()))) for p, rule in RULES.items()])
    violations = F.sort_array(F.array_distinct(F.concat("_blocking", release_rule("_blocking"))))
    return (
        inputs.withColumn("_blocking", blocking)
        .withColumn("violations", violations)
        .drop("_blocking")
    )


def violations_table(evaluated: DataFrame) -> DataFrame:
    """One row per violation.

    The outer explode keeps the optimizer from filtering on the size of the array below
    the projection, which would evaluate every rule a second time.
    """
    return (
        evaluated.select(
            F.col("experiment.run_key").alias("run_key"),
            F.col("evaluation_stage").alias("stage"),
            F.explode_outer("violations").alias("v"),
        )
        .where(F.col("v").isNotNull())
        .select("run_key", "stage", "v.policy_id", "v.category", "v.severity", "v.reason", "v.details")
    )


def _catalog_column() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(policy_id).alias("policy_id"),
                F.lit(category).alias("category"),
                F.lit(title).alias("title"),
                F.lit(severity).alias("severity"),
                F.array(*[F.lit(s) for s in stages]).alias("stages"),
            )
            for policy_id, category, title, severity, stages in POLICY_CATALOG
        ]
    )


def policy_outcomes(evaluated: DataFrame) -> DataFrame:
    """Catalog x run: PASS, DENY or NOT_APPLICABLE; a violation raised outside the catalog
    stage, or by a policy the catalog does not know, becomes a guard row."""
    known = F.array(*[F.lit(p[0]) for p in POLICY_CATALOG])

    def outcome(policy: Column) -> Column:
        mine = F.filter(F.col("violations"), lambda v: v["policy_id"] == policy["policy_id"])
        applicable = F.array_contains(policy["stages"], F.col("evaluation_stage"))
        count = F.size(mine)
        return F.struct(
            policy["policy_id"].alias("policy_id"),
            policy["category"].alias("category"),
            applicable.alias("applicable"),
            F.when(~applicable & (count > 0), "OUT_OF_STAGE")
            .when(~applicable, "NOT_APPLICABLE")
            .when(count > 0, "DENY")
            .otherwise("PASS")
            .alias("outcome"),
            count.cast("bigint").alias("violation_count"),
            F.array_join(
                F.sort_array(F.array_distinct(F.transform(mine, lambda v: v["reason"]))), "; "
            ).alias("reasons"),
        )

    unknown = F.transform(
        F.array_distinct(
            F.filter(
                F.transform(F.col("violations"), lambda v: v["policy_id"]),
                lambda p: ~F.array_contains(known, p),
            )
        ),
        lambda p: F.struct(
            p.alias("policy_id"),
            F.lit("unknown").alias("category"),
            F.lit(False).alias("applicable"),
            F.lit("UNKNOWN_POLICY").alias("outcome"),
            F.lit(1).cast("bigint").alias("violation_count"),
            F.lit("").alias("reasons"),
        ),
    )
    return evaluated.select(
        F.col("experiment.run_key").alias("run_key"),
        F.col("evaluation_stage").alias("stage"),
        F.explode(F.concat(F.transform(_catalog_column(), outcome), unknown)).alias("o"),
    ).select("run_key", "stage", "o.*")


def decisions(evaluated: DataFrame) -> DataFrame:
    """One decision per (run, stage): ALLOW exactly when nothing is violated."""
    triggered = F.sort_array(
        F.array_distinct(F.transform("violations", lambda v: v["policy_id"]))
    )
    stage = F.col("evaluation_stage")
    in_stage = F.filter(_catalog_column(), lambda p: F.array_contains(p["stages"], stage))
    denied = F.filter(in_stage, lambda p: F.array_contains(F.col("triggered_policy_ids"), p["policy_id"]))
    count = F.size("violations")
    requested = F.coalesce("release.promotion_requested", F.lit(False))
    return evaluated.withColumn("triggered_policy_ids", triggered).select(
        F.col("experiment.run_key").alias("run_key"),
        F.col("experiment.scenario_id").alias("scenario_id"),
        F.col("experiment.condition").alias("condition"),
        stage,
        *[F.col(c) for c in ("recorded_at",) if c in evaluated.columns],
        F.when(count == 0, "ALLOW").otherwise("DENY").alias("decision"),
        (count == 0).alias("allow"),
        count.cast("bigint").alias("violation_count"),
        "triggered_policy_ids",
        F.size(in_stage).cast("bigint").alias("applicable_policy_count"),
        F.size(denied).cast("bigint").alias("denied_policy_count"),
        requested.alias("promotion_requested"),
        (requested & (count > 0)).alias("promotion_blocked"),
        "violations",
    )
