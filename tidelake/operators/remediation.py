"""Remediation of denied releases: eligibility, plans, redaction, quarantine, recovery."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.scalar import identifier, parse_iso_utc, rounded_ratio
from tidelake.session import small_table
from tidelake.sources.sinks import content_hash

# The remediation catalog. Per scenario: primary action, fallback action,
# attempts, timeout in seconds, target scope, detection stage, automatic, required checks.
REMEDIATION_CATALOG = [
    (
        "freshness_breach",
        "retry",
        "quarantine",
        2,
        300,
        "isolated_output",
        "post",
        True,
        ["freshness", "runtime", "release_policy"],
    ),
    (
        "pii_exposure",
        "redact_republish",
        "quarantine",
        1,
        300,
        "isolated_public_candidate",
        "pre",
        True,
        ["privacy", "schema_contract", "release_policy"],
    ),
    (
        "policy_false_positive",
        "manual_review",
        "stop_promotion",
        0,
        0,
        "release_state",
        "pre",
        False,
        ["manual_policy_review"],
    ),
    (
        "quality_regression",
        "rollback",
        "quarantine",
        1,
        300,
        "isolated_output",
        "post",
        True,
        ["quality", "runtime", "release_policy"],
    ),
    (
        "schema_break",
        "rollback",
        "manual_review",
        1,
        300,
        "isolated_release_candidate",
        "pre",
        True,
        ["schema_contract", "release_policy"],
    ),
]

# Recovery check -> policy that must not be triggered any more.
CHECK_POLICIES = {
    "schema_contract": "PAC-SCHEMA-001",
    "privacy": "PAC-PRIVACY-001",
    "freshness": "PAC-FRESH-001",
    "quality": "PAC-QUALITY-001",
    "runtime": "PAC-RUNTIME-001",
    "release_policy": "PAC-RELEASE-001",
}

# Scenario -> (blocking policy, category) of a quarantine.
QUARANTINE_POLICIES = {
    "pii_exposure": ("PAC-PRIVACY-001", "privacy"),
    "freshness_breach": ("PAC-FRESH-001", "freshness"),
    "quality_regression": ("PAC-QUALITY-001", "quality"),
}

# Quarantine paths, ids and bounds.
SOURCE_PREFIX = "experiments/c2/"
QUARANTINE_PREFIX = "quarantine/objects/"
EVENT_ID_PREFIX = "c2-q-"
RETRY_LIMIT = 2

# An address is [A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}; a match starts where its run
# of local characters does, or where the match before it ended.
EMAIL_MASK = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
)
PHONE_MASK = r"\+?\d(?:[\s().-]*+\+?+\d){7,}+"


def catalog_table(spark: SparkSession) -> DataFrame:
    """The catalog as a table: one row per scenario, five rows."""
    return small_table(
        spark,
        REMEDIATION_CATALOG,
        "scenario_id string, primary_action string, fallback_action string, max_attempts int,"
        " timeout_seconds int, target_scope string, detection_stage string, automatic boolean,"
        " verification array<string>",
    )


def _with_catalog(decisions: DataFrame) -> DataFrame:
    # Five fixed rows, so the broadcast has a size bound.
    return decisions.join(F.broadcast(catalog_table(decisions.sparkSession)), "scenario_id", "left")


def eligibility(decisions: DataFrame) -> DataFrame:
    """Decisions with the first reason that keeps them from remediation, NULL if none."""
    triggered = F.col("triggered_policy_ids")
    reason = (
        F.when(F.coalesce(F.length(F.btrim("run_key")), F.lit(0)) == 0, "run_key_missing")
        .when(F.col("recorded_at").isNull(), "recorded_at_missing")
        .when(F.col("detection_stage").isNull(), "scenario_unknown")
        .when(F.col("evaluation_stage") != F.col("detection_stage"), "stage_mismatch")
        .when((F.col("decision") != "DENY") | F.col("allow"), "not_denied")
        .when(~F.col("promotion_requested"), "promotion_not_requested")
        .when(F.size(triggered) == 0, "no_triggered_policy")
        .when(F.size(F.array_distinct(triggered)) != F.size(triggered), "triggered_not_unique")
        .when(~F.col("promotion_blocked"), "promotion_not_blocked")
    )
    return _with_catalog(decisions).withColumn("reject_reason", reason)


def remediation_plans(eligible: DataFrame) -> DataFrame:
    """The catalog's bounded plan for every eligible decision."""
    # The sentence of the rationale.
    rationale = F.concat(
        F.lit("Policy DENY selected the catalog-governed bounded remediation plan for "),
        F.col("scenario_id"),
        F.lit(": "),
        F.col("primary_action"),
        F.lit(" with fallback "),
        F.col("fallback_action"),
        F.lit("."),
    )
    return eligible.where(F.col("reject_reason").isNull()).select(
        "run_key",
        "scenario_id",
        "evaluation_stage",
        F.col("recorded_at").alias("fault_detected_at"),
        F.when(F.col("automatic"), "automatic").otherwise("manual").alias("mode"),
        "primary_action",
        "fallback_action",
        "max_attempts",
        "timeout_seconds",
        "target_scope",
        "verification",
        rationale.alias("rationale"),
    )


# ---- redaction ---------------------------------------------------------------------


def mask_pii(text: Column | str) -> Column:
    """E-mail addresses and phone numbers replaced by a label."""
    masked = F.regexp_replace(text, EMAIL_MASK, "[email]")
    return F.regexp_replace(masked, PHONE_MASK, "[phone]")


def redact(df: DataFrame, drop: list[str], mask: list[str]) -> DataFrame:
    """Candidate without its forbidden columns and with masked text."""
    kept = df.drop(*[c for c in drop if c in df.columns])
    return kept.withColumns({c: mask_pii(c) for c in mask if c in kept.columns})


# ---- versions and rollback -----------------------------------------------------------


def write_version(
    df: DataFrame, root: str, dataset: str, version: int, status: str
) -> DataFrame:
    """Write one version of a dataset and record it in the version log (single writer)."""
    path = f"{root.rstrip('/')}/versions/{dataset}/v{version}"
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    written = spark.read.schema(df.schema).parquet(path)
    entry = content_hash(written).select(
        F.lit(dataset).alias("dataset"),
        F.lit(version).alias("version"),
        F.lit(path).alias("path"),
        F.lit(status).alias("status"),
        "row_count",
        "content_sha256",
    )
    entry.write.mode("append").parquet(f"{root.rstrip('/')}/version_log")
    return written


def last_verified(spark: SparkSession, root: str, dataset: str):
    """Log entry of the newest version that passed; one row."""
    log = spark.read.parquet(f"{root.rstrip('/')}/version_log")
    passed = log.where((F.col("dataset") == dataset) & (F.col("status") == "PASS"))
    return passed.orderBy(F.desc("version")).first()


def rollback(spark: SparkSession, root: str, dataset: str, next_version: int) -> DataFrame:
    """Publish the last verified content again as a new version and compare the hashes."""
    entry = last_verified(spark, root, dataset)
    if entry is None:
        raise LookupError(f"{dataset} has no verified version")
    restored = write_version(
        spark.read.parquet(entry["path"]), root, dataset, next_version, "PASS"
    )
    return content_hash(restored).select(
        F.lit(dataset).alias("dataset"),
        F.lit(entry["version"]).cast("bigint").alias("restored_version"),
        "row_count",
        "content_sha256",
        (F.col("content_sha256") == entry["content_sha256"]).alias("content_equal"),
    )


# ---- quarantine ----------------------------------------------------------------------


def split_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every row with the first policy it breaks; NULL for the rows that pass."""
    broken = F.coalesce(
        *[F.when(F.coalesce(c, F.lit(False)), F.lit(p)) for p, c in rules.items()]
    )
    return df.withColumn("policy_id", broken)


def quarantine_dataset(df: DataFrame, root: str, dataset: str, run_id: str) -> DataFrame:
    """Copy a rejected dataset, unchanged, to the quarantine zone and compare the content."""
    path = f"{root.rstrip('/')}/quarantine/{dataset}/{run_id}"
    df.write.mode("errorifexists").parquet(path)
    moved = df.sparkSession.read.schema(df.schema).parquet(path)
    digest = content_hash(df).select("content_sha256").scalar()
    return content_hash(moved).select(
        F.lit(dataset).alias("dataset"),
        "row_count",
        "content_sha256",
        (F.col("content_sha256") == digest).alias("content_equal"),
    )


# Fields of a quarantine request.
REQUEST_FIELDS = [
    "condition",
    "run_id",
    "scenario_id",
    "source_bucket",
    "source_key",
    "source_dataset",
    "source_relation",
    "policy_category",
    "policy_id",
    "violation_code",
    "violation_details",
    "data_classification",
    "detected_at",
    "retry_count",
    "max_retries",
    "evidence_uri",
]


def validate_requests(requests: DataFrame, bucket: str) -> DataFrame:
    """Quarantine requests with the first reason they are refused, NULL if none."""
    missing = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in REQUEST_FIELDS])
    steps = F.split("source_key", "/")

    def out_of_bounds(name: str) -> Column:
        return ~F.col(name).between(0, RETRY_LIMIT)

    reason = (
        F.when(missing, "missing_field")
        .when(F.col("condition") != "C2", "condition_not_accepted")
        .when(~F.col("scenario_id").isin(*QUARANTINE_POLICIES), "scenario_not_eligible")
        .when(F.col("source_bucket") != bucket, "bucket_mismatch")
        .when(~F.startswith("source_key", F.lit(SOURCE_PREFIX)), "outside_source_boundary")
        .when(F.array_contains(steps, ".."), "path_traversal")
        .when(out_of_bounds("retry_count"), "retry_count_out_of_bounds")
        .when(out_of_bounds("max_retries"), "max_retries_out_of_bounds")
        .when(F.col("retry_count") > F.col("max_retries"), "retry_count_above_max")
        .when(parse_iso_utc("detected_at").isNull(), "bad_timestamp")
        .when(identifier("run_id").isNull(), "empty_identifier")
        .when(identifier(F.element_at(steps, -1)).isNull(), "empty_identifier")
    )
    return requests.withColumn("reject_reason", reason)


def quarantine_events(requests: DataFrame, quarantined_at: Column, bucket: str) -> DataFrame:
    """One event of 23 columns per accepted request; its id depends on the request alone."""
    name = F.element_at(F.split("source_key", "/"), -1)
    destination = F.concat(
        F.lit(f"s3://{bucket}/{QUARANTINE_PREFIX}"),
        identifier("scenario_id"),
        F.lit("/"),
        identifier("run_id"),
        F.lit("/"),
        identifier(name),
    )
    material = F.concat_ws(
        "|", "run_id", "scenario_id", "source_key", "rejected_output_location", "detected_at"
    )
    rows = requests.withColumn("rejected_output_location", destination)
    # The columns of an event, and the states of a fresh one.
    event_id = F.concat(F.lit(EVENT_ID_PREFIX), F.substring(F.sha2(material, 256), 1, 24))
    return rows.select(
        event_id.alias("quarantine_event_id"),
        "run_id",
        "scenario_id",
        "source_dataset",
        "source_relation",
        "rejected_output_location",
        "policy_category",
        "policy_id",
        "violation_code",
        "violation_details",
        "data_classification",
        parse_iso_utc("detected_at").alias("detected_at"),
        quarantined_at.cast("timestamp").alias("quarantined_at"),
        F.lit("quarantine").alias("remediation_action"),
        F.lit("SUCCEEDED").alias("remediation_status"),
        F.col("retry_count").cast("bigint").alias("retry_count"),
        F.col("max_retries").cast("bigint").alias("max_retries"),
        F.lit(False).alias("manual_review_required"),
        F.lit("NOT_REQUIRED").alias("manual_review_status"),
        F.lit("BLOCKED").alias("release_status"),
        F.lit(None).cast("timestamp").alias("released_at"),
        F.lit("QUARANTINED").alias("final_state"),
        "evidence_uri",
    )


def append_events(events: DataFrame, path: str) -> DataFrame:
    """Append the events that are not in the table yet; a replay adds nothing.

    The table is partitioned by the day of detection. An event's id is made of the moment it was
    detected, among others, so a replay can only repeat events of its own days: the look-up reads
    the partitions of these days and no more of the history. Assumes one writer at a time: Parquet
    folders have no transactions.
    """
    spark = events.sparkSession
    new = events.dropDuplicates(["quarantine_event_id"]).withColumn(
        "detected_date", F.to_date("detected_at")
    )
    try:
        history = spark.read.schema(new.schema).parquet(path)
        new = new.join(known_events(new, history), "quarantine_event_id", "left_anti")
        new = new.select(*history.columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise  # only a first append may find no table
    new.write.mode("append").partitionBy("detected_date").parquet(path)
    return spark.read.schema(new.schema).parquet(path).select(*events.columns)


def known_events(new: DataFrame, history: DataFrame) -> DataFrame:
    """Ids of the history on the days of the new events; as many days as the append has."""
    days = [r[0] for r in new.select("detected_date").distinct().collect()]
    return history.where(F.col("detected_date").isin(days)).select("quarantine_event_id")


# ---- recovery ------------------------------------------------------------------------

RUN_STAGE = ["run_key", "evaluation_stage"]


def _identified(decisions: DataFrame) -> DataFrame:
    """Decisions that name their run. The others could only pile up on one join key."""
    return decisions.where(F.length(F.btrim("run_key")) > 0)


def check_results(plans: DataFrame, recovered: DataFrame) -> DataFrame:
    """Required checks of every plan against the policies its recovered evidence triggers."""
    policy = F.create_map(*[F.lit(v) for pair in CHECK_POLICIES.items() for v in pair])
    after = _identified(recovered).select(
        *RUN_STAGE, F.col("triggered_policy_ids").alias("_triggered")
    )
    checks = plans.join(after, RUN_STAGE, "left").withColumn(
        "check_name", F.explode("verification")
    )
    checks = checks.withColumn("policy_id", policy[F.col("check_name")])
    status = (
        F.when(F.col("check_name") == "manual_policy_review", "PENDING")
        .when(F.col("policy_id").isNull() | F.col("_triggered").isNull(), "ERROR")
        .when(F.array_contains("_triggered", F.col("policy_id")), "FAIL")
        .otherwise("PASS")
    )
    return checks.select("run_key", "scenario_id", "check_name", "policy_id", status.alias("status"))


def verify_recovery(plans: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recovery per plan: RECOVERED with its time, or the fallback that applies.

    Both inputs hold one row per run and stage, so this is one join on that key.
    """
    after = _identified(recovered).select(
        *RUN_STAGE,
        F.col("allow").alias("policy_allow"),
        F.col("violation_count").alias("remaining_violations"),
        F.col("triggered_policy_ids").alias("remaining_policies"),
        F.col("violations").alias("remaining"),
        F.col("recorded_at").alias("completed_at"),
    )
    policy = F.create_map(*[F.lit(v) for pair in CHECK_POLICIES.items() for v in pair])
    checks_pass = F.forall(
        "verification", lambda c: ~F.array_contains(F.col("remaining_policies"), policy[c])
    )
    passed = (F.col("mode") == "automatic") & F.col("policy_allow") & checks_pass
    status = (
        F.when(F.col("mode") == "manual", "PENDING")
        .when(F.coalesce(passed, F.lit(False)), "PASS")
        .otherwise("FAIL")
    )
    micros = F.unix_micros("completed_at") - F.unix_micros("fault_detected_at")
    recovered_now = F.col("verification_status") == "PASS"
    return (
        plans.join(after, RUN_STAGE, "left")
        .withColumn("verification_status", status)
        .withColumns(
            {
                "terminal_state": F.when(recovered_now, "RECOVERED"),
                "recovery_time_ms": F.when(recovered_now, F.round(micros / 1000.0, 3)),
                "recommended_fallback": F.when(~recovered_now, F.col("fallback_action")),
                "promotion_blocked": ~recovered_now,
            }
        )
    )


def fallback_routes(verified: DataFrame) -> DataFrame:
    """Where each unrecovered run goes. A quarantine needs exactly one violation of its
    scenario's policy; otherwise the run is refused with the number found."""
    policy = F.create_map(*[F.lit(v) for s, (p, _) in QUARANTINE_POLICIES.items() for v in (s, p)])
    category = F.create_map(*[F.lit(v) for s, (_, c) in QUARANTINE_POLICIES.items() for v in (s, c)])
    rows = verified.where("verification_status <> 'PASS'").withColumns(
        {"policy_id": policy[F.col("scenario_id")], "policy_category": category[F.col("scenario_id")]}
    )
    matching = F.size(
        F.filter("remaining", lambda v: v["policy_id"] == F.col("policy_id"))
    ).cast("bigint")
    is_quarantine = F.col("recommended_fallback") == "quarantine"
    one = F.col("matching_violations") == 1
    route = (
        F.when(is_quarantine & one, "QUARANTINED")
        .when(is_quarantine, "REFUSED")
        .when(F.col("recommended_fallback") == "manual_review", "MANUAL_REVIEW")
        .otherwise("PROMOTION_STOPPED")
    )
    return rows.withColumn("matching_violations", F.when(is_quarantine, matching)).select(
        "run_key",
        "scenario_id",
        F.col("recommended_fallback").alias("fallback_action"),
        "policy_id",
        "policy_category",
        "matching_violations",
        route.alias("terminal_state"),
    )


# ---- experiment metrics ----------------------------------------------------------------


def experiment_metrics(runs: DataFrame, *by: str) -> DataFrame:
    """Prevention, escape, false-positive and manual rates, treatment time and MTTR.

    ``runs`` has unsafe, prevented, denied and manual flags, treatment_seconds,
    final_state, verification_status and recovery_seconds. Only verified recoveries enter
    the recovery time; other outcomes are censored.
    """
    unsafe, safe = F.col("unsafe"), ~F.col("unsafe")

    def percent(part: Column, whole: Column) -> Column:
        shares = rounded_ratio(F.count_if(whole & part) * 100, F.count_if(whole))
        return F.when(F.count_if(whole) > 0, shares)

    recovered = (F.col("final_state") == "RECOVERED") & (F.col("verification_status") == "PASS")
    seconds = F.when(recovered, F.col("recovery_seconds"))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        percent(F.col("prevented"), unsafe).alias("unsafe_prevented_pct"),
        percent(~F.col("prevented"), unsafe).alias("escape_pct"),
        percent(F.col("denied"), safe).alias("false_positive_pct"),
        percent(F.col("manual"), F.lit(True)).alias("manual_pct"),
        F.round(F.avg("treatment_seconds"), 3).alias("mean_treatment_seconds"),
        F.count(seconds).alias("verified_recoveries"),
        F.round(F.avg(seconds), 3).alias("mttr_seconds"),
        F.round(F.stddev_samp(seconds), 3).alias("mttr_sample_sd"),
    )
