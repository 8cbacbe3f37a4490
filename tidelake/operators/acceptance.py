"""Acceptance of delivered datasets and of pipeline runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators import quality as Q
from tidelake.session import small_table


def contact_metrics(contact: DataFrame) -> DataFrame:
    """Twelve counters of the contact table in one pass."""
    pii = F.col("pii_classification") == "PII"
    consent = F.col("marketing_consent")
    return contact.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("customer_id").alias("distinct_customer_ids"),
        F.count_distinct("synthetic_email").alias("distinct_synthetic_emails"),
        F.count_distinct("synthetic_phone").alias("distinct_synthetic_phones"),
        F.count_if(consent).alias("consent_true_rows"),
        F.count_if(~consent).alias("consent_false_rows"),
        F.count_if(consent.isNull()).alias("null_consent_rows"),
        F.count_if(pii).alias("pii_rows"),
        F.count_if(~pii | F.col("pii_classification").isNull()).alias("non_pii_or_null_rows"),
        F.count_if(F.col("customer_id").isNull()).alias("null_customer_ids"),
        F.count_if(F.col("synthetic_email").isNull()).alias("null_synthetic_emails"),
        F.count_if(F.col("synthetic_phone").isNull()).alias("null_synthetic_phones"),
    )


def accept_contact(contact: DataFrame, dataset: str, constraints: dict[str, int]) -> DataFrame:
    """Delivered contact table against the constraints its manifest states."""
    m = contact_metrics(contact)
    rows = constraints["expected_rows"]
    wanted = {
        "row_count_matches": ("total_rows", rows),
        "customer_ids_unique": ("distinct_customer_ids", constraints["unique_customer_ids"]),
        "emails_unique": ("distinct_synthetic_emails", constraints["unique_synthetic_emails"]),
        "phones_unique": ("distinct_synthetic_phones", constraints["unique_synthetic_phones"]),
        "consent_true_matches": ("consent_true_rows", constraints["marketing_consent_true"]),
        "consent_false_matches": ("consent_false_rows", constraints["marketing_consent_false"]),
        "no_null_consent": ("null_consent_rows", 0),
        "classification_constant": ("non_pii_or_null_rows", 0),
        "no_empty_customer_id": ("null_customer_ids", 0),
        "no_empty_email": ("null_synthetic_emails", 0),
        "no_empty_phone": ("null_synthetic_phones", 0),
    }
    checks = [
        Q.Check(name, F.max(column), str(value), f"{{v}} = {value}")
        for name, (column, value) in wanted.items()
    ]
    return Q.run_checks(m, dataset, checks)


def accept_runs(stages: DataFrame, expected: list[str]) -> DataFrame:
    """One row per run: stage sequence, statuses, exit codes and durations.

    A run is in sequence when its stages, by order number, are exactly the expected ones;
    that is checked by position, so no stage list is collected.
    """
    wanted = F.array(*[F.lit(s) for s in expected])
    named = F.try_element_at(wanted, F.col("stage_order").cast("int"))
    in_place = F.coalesce(named == F.col("stage_name"), F.lit(False))
    good_order = (F.col("stage_order") >= 1) & in_place
    runs = stages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("executed_stages"),
        F.count_distinct(F.when(good_order, F.col("stage_order"))).alias("stages_in_place"),
        F.count_if(F.coalesce(F.col("status") != "PASS", F.lit(True))).alias("failed_stages"),
        F.count_if(F.coalesce(F.col("exit_code") != 0, F.lit(True))).alias("nonzero_exit_codes"),
        F.count_if(F.coalesce(F.col("duration_seconds") <= 0, F.lit(True))).alias(
            "invalid_durations"
        ),
    )
    sequence = (F.col("executed_stages") == len(expected)) & (
        F.col("stages_in_place") == len(expected)
    )
    faults: Column = (
        F.col("failed_stages") + F.col("nonzero_exit_codes") + F.col("invalid_durations")
    )
    return runs.withColumn("stage_sequence_correct", sequence).withColumn(
        "overall_status",
        F.when(F.col("stage_sequence_correct") & (faults == 0), "PASS").otherwise("FAIL"),
    )


def accept_suites(
    results: dict[str, DataFrame], checks: dict[str, int], datasets: dict[str, int]
) -> DataFrame:
    """One row per validation suite: its datasets, checks and failures against what is expected.

    A suite that runs too few checks is refused even if all of them pass.
    """
    parts = [df.select(F.lit(suite).alias("suite"), "dataset", "status") for suite, df in results.items()]
    named = F.col("dataset") != "contracts"
    counted = Q.union_all(parts).groupBy("suite").agg(
        F.count_distinct(F.when(named, F.col("dataset"))).alias("dataset_count"),
        F.count(F.lit(1)).alias("check_count"),
        F.count_if(F.coalesce(F.col("status") != "PASS", F.lit(True))).alias("failed_checks"),
    )
    wanted = small_table(
        counted.sparkSession,
        [(suite, datasets[suite], n) for suite, n in checks.items()],
        "suite string, expected_datasets bigint, expected_checks bigint",
    )
    joined = wanted.join(counted, "suite", "left").na.fill(0)
    complete = (F.col("dataset_count") == F.col("expected_datasets")) & (
        F.col("check_count") == F.col("expected_checks")
    )
    return joined.withColumn("suite_complete", complete).withColumn(
        "status",
        F.when(F.col("suite_complete") & (F.col("failed_checks") == 0), "PASS").otherwise("FAIL"),
    )
