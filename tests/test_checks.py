"""Checks fire on broken input; joins, contracts and governance refuse what they must."""

import pytest
from pyspark.sql import functions as F

from tidelake.operators import acceptance, contracts, governance, joins, profile
from tidelake.operators import quality as Q
from tidelake.plans import lakehouse, rules, silver
from tidelake.sources.testdata import raw_tables


def states(results):
    return {r["check_name"]: (r["status"], r["observed_value"]) for r in results.collect()}


def test_row_checks_fire(spark):
    df = spark.createDataFrame(
        [(1, -1.0, 5.0), (1, 2.0, None), (None, 3.0, 99.0)], "k int, m double, s double"
    )
    got = states(
        Q.run_checks(
            df,
            "d",
            [Q.not_empty(), Q.key_not_null(["k"]), *Q.non_negative(["m"]),
             Q.within("s_in_range", "s", 1, 5), Q.no_null_cells(df)],
        )
    )
    assert got == {
        "dataset_not_empty": ("PASS", "3"),
        "primary_key_not_null": ("FAIL", "1"),
        "m_non_negative": ("FAIL", "1"),
        "s_in_range": ("FAIL", "2"),
        "no_null_cells": ("FAIL", "2"),
    }
    assert states(Q.run_checks(df.where("m > 9"), "d", [Q.not_empty()])) == {
        "dataset_not_empty": ("FAIL", "0")
    }


def test_duplicates_count_all_rows_of_a_repeated_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, None)], "k int, v string")
    assert states(Q.key_unique(df, "d", ["k"])) == {"primary_key_unique": ("FAIL", "4")}
    assert states(Q.no_full_duplicates(df, "d")) == {"no_full_duplicate_rows": ("FAIL", "1")}
    empty = df.where("k > 5")
    assert states(Q.key_unique(empty, "d", ["k"])) == {"primary_key_unique": ("PASS", "0")}
    assert states(Q.no_full_duplicates(empty, "d")) == {"no_full_duplicate_rows": ("PASS", "0")}


def test_foreign_key_counts_null_as_orphan(spark):
    child = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    parent = spark.createDataFrame([("a",), ("a",)], "p string")
    got = states(Q.foreign_key(child, "d", "fk", "k", parent, "p"))
    assert got == {"fk": ("FAIL", "2")}


def test_coverage(spark):
    whole = spark.createDataFrame([(i,) for i in range(3)], "k int")
    assert states(Q.coverage(whole.where("k < 2"), whole, "d", "c", "k")) == {
        "c": ("FAIL", "66.6667")
    }
    assert states(Q.coverage(whole, whole, "d", "c", "k")) == {"c": ("PASS", "100.0")}


def test_checked_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(left, right, ["k"])
    one = right.where("v = 'x'")
    assert joins.checked_join(left, one, ["k"]).count() == 2
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(left, one, ["k"], validate="one_to_one")


def test_roll_up_passes_only_without_critical_failures(spark):
    rows = [("d", "PASS", "critical"), ("d", "FAIL", "warning"), ("e", "FAIL", "critical")]
    results = spark.createDataFrame(rows, "dataset string, status string, severity string")
    got = {r["dataset"]: r["overall_status"] for r in Q.roll_up(results, "dataset").collect()}
    assert got == {"d": "PASS", "e": "FAIL"}


def contract_frame(spark, columns):
    kinds = {"date": "date", "string": "string", "integer": "bigint", "decimal": "double"}
    declared = rules.GOLD_COLUMNS["gold_customer_order_summary"]
    text = ", ".join(f"{c} {kinds[declared.get(c, 'string')]}" for c in columns)
    return spark.createDataFrame([], text)


def test_contract_column_rules(spark):
    name = "gold_customer_order_summary"
    contract = rules.gold_contract(name)
    declared = list(rules.GOLD_COLUMNS[name])

    def failed(columns, use=contract):
        return [r[0] for r in contracts.column_checks(use, columns) if not r[1]]

    assert failed(declared) == []
    assert "all_declared_columns_present" in failed(declared[:-1])
    assert failed([*declared, "loyalty_tier"]) == []
    assert failed([declared[1], declared[0], *declared[2:]]) == ["declared_column_order_matches"]
    public = rules.gold_contract("gold_public_sales_dashboard")
    columns = [c.name for c in public.columns]
    assert failed([*columns, "extra"], public) == ["unexpected_columns_compatible"]


def test_contract_privacy_and_destination_rules():
    summary = rules.gold_contract("gold_customer_order_summary")
    names = [c.name for c in summary.columns]
    bad = [r[0] for r in contracts.privacy_checks(summary, "gold/public", names) if not r[1]]
    assert bad == ["customer_unique_id_pii_destination_valid"]
    placed = {r[0]: r[1] for r in contracts.destination_checks(summary, "gold/public")}
    assert placed == {"destination_allowed": False, "destination_not_forbidden": False}
    public = rules.gold_contract("gold_public_sales_dashboard")
    leaked = [r[0] for r in contracts.privacy_checks(public, "gold/public", ["synthetic_email"])
              if not r[1]]
    assert leaked == ["forbidden_fields_absent"]


def test_contract_from_document_reports_what_is_missing():
    contract = contracts.Contract.from_mapping({"dataset": "d", "columns": {"a": {"type": "uuid"}}})
    failed = {r[0]: r[2] for r in contracts.metadata_checks(contract, "other") if not r[1]}
    assert failed["contract_dataset_matches_name"] == "d"
    assert "owner" in failed["required_contract_metadata_present"]
    assert "freshness_slo_positive" in failed and "compatibility_rules_complete" in failed
    assert contract.columns[0].type == "uuid"


def test_contract_types(spark):
    rows = [("1", "x", "yes"), ("1.5", "2024-02-30", "maybe"), (None, "2024-02-29", None)]
    df = spark.createDataFrame(rows, "n string, d string, b string")
    kinds = [("n", "integer"), ("n", "decimal"), ("d", "date"), ("b", "boolean"), ("b", "uuid")]
    got = states(
        Q.run_checks(
            df, "d", [Q.violations(f"{c}_{k}", contracts.type_violation(c, k)) for c, k in kinds]
        )
    )
    assert {k: v[1] for k, v in got.items()} == {
        "n_integer": "1", "n_decimal": "0", "d_date": "2", "b_boolean": "1", "b_uuid": "2",
    }


def test_public_zone_refuses_identifiers(spark):
    good = spark.createDataFrame([], "order_date date, customer_state string")
    assert lakehouse.check_zone("gold_public_sales_dashboard", good) == "gold/public"
    bad = good.withColumn("customer_email", F.lit("x"))
    with pytest.raises(ValueError):
        lakehouse.check_zone("gold_public_sales_dashboard", bad)
    assert contracts.forbidden_name_parts(["Customer_ID", "total"]) == ["customer_id"]


def test_silver_keeps_reviews_that_differ_and_drops_copies(spark):
    columns = ["review_id", "order_id", "review_score", "review_comment_title",
               "review_comment_message", "review_creation_date", "review_answer_timestamp"]
    base = ("r", "o", "5", None, "m", "2018-01-01 00:00:00", "")
    rows = [base, base, base[:3] + ("t",) + base[4:], base[:4] + (" n ",) + base[5:]]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    got = silver.silver_reviews(raw).orderBy("review_occurrence").collect()
    assert [(r["review_occurrence"], r["review_comment_title"], r["review_comment_message"])
            for r in got] == [(1, None, "m"), (2, None, "n"), (3, "t", "m")]
    assert len({r["review_record_id"] for r in got}) == 3


def test_geolocation_median_and_mode(spark):
    rows = [("1", "2", "1", "A ", "x"), ("1", "4", "3", "a", "y"), ("1", "x", "2", "b", None),
            ("none", "1", "1", "z", "z"), ("2", "", "", "", "")]
    raw = spark.createDataFrame(
        rows,
        "geolocation_zip_code_prefix string, geolocation_lat string, geolocation_lng string,"
        " geolocation_city string, geolocation_state string",
    )
    got = {r[0]: tuple(r)[1:] for r in silver.silver_geolocation(raw).collect()}
    assert got == {1: (3.0, 2.0, "a", "X", 3), 2: (None, None, None, None, 1)}


def test_run_acceptance(spark):
    stages = ["a", "b"]
    rows = [("ok", 1, "a", "PASS", 0, 1.0), ("ok", 2, "b", "PASS", 0, 1.0),
            ("swapped", 1, "b", "PASS", 0, 1.0), ("swapped", 2, "a", "PASS", 0, 1.0),
            ("short", 1, "a", "PASS", 0, 1.0),
            ("slow", 1, "a", "PASS", 0, 0.0), ("slow", 2, "b", "FAIL", 1, 1.0)]
    frame = spark.createDataFrame(
        rows, "run_id string, stage_order int, stage_name string, status string, exit_code int,"
        " duration_seconds double",
    )
    got = {r["run_id"]: (r["stage_sequence_correct"], r["overall_status"])
           for r in acceptance.accept_runs(frame, stages).collect()}
    assert got == {"ok": (True, "PASS"), "swapped": (False, "FAIL"), "short": (False, "FAIL"),
                   "slow": (True, "FAIL")}


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    got = profile.column_profile(df, "d").orderBy("column_name").collect()
    assert [(r["row_count"], r["null_percentage"], r["sample_values"]) for r in got] == [
        (0, 0.0, ""), (0, 0.0, ""),
    ]


def test_source_gate_codes(spark):
    expected = spark.createDataFrame(
        [("db", t) for t in "abcdefgh"], "database_name string, table_name string"
    )
    rows = [
        ("db", "b", "VIEW", "s3://lake/raw/b", "x"),
        ("db", "c", "EXT", None, "x"),
        ("db", "d", "EXT", "nowhere", "x"),
        ("db", "e", "EXT", "s3://other/raw/e", "x"),
        ("db", "f", "EXT", "s3://lake/tmp/f", "x"),
        ("db", "g", "EXT", "s3://lake/raw/g", None),
        ("db", "h", "EXT", "s3://lake/raw/h", "x"),
    ]
    catalog = spark.createDataFrame(
        rows, "database_name string, table_name string, table_type string, location string,"
        " first_object string",
    )
    checks = governance.gate_sources(expected, catalog, "EXT", "lake", "raw/")
    codes = [r["violation_code"] for r in checks.orderBy("table_name").collect()]
    assert codes == [*governance.GATE_CODES, None]
    assert governance.gate_result(checks).first()["status"] == "BLOCKED"


def test_broken_seal_is_found(spark, tmp_path):
    records = spark.createDataFrame([(1, "a"), (2, "b")], "i int, v string")
    sealed = governance.append_evidence(records, str(tmp_path / "e"))
    assert governance.broken_seals(sealed).isEmpty()
    edited = sealed.withColumn("v", F.when(F.col("i") == 2, "c").otherwise(F.col("v")))
    assert [r["i"] for r in governance.broken_seals(edited).collect()] == [2]


def test_query_log_without_queries_fails(spark):
    log = spark.createDataFrame(
        [], "submitted_at timestamp, database string, query string, state string,"
        " scanned_bytes bigint, engine_ms bigint",
    )
    assert governance.query_roll_up(log).first()["status"] == "FAIL"


def test_silver_validation_finds_the_given_faults(spark, sf):
    tables = silver.build_silver(raw_tables(spark, sf))
    failed = {
        (r["dataset"], r["check_name"])
        for r in rules.validate_silver(tables).where("status = 'FAIL'").collect()
    }
    assert ("silver_order_items", "primary_key_unique") in failed
    assert ("silver_reviews", "review_score_between_1_and_5") in failed
    assert ("silver_orders", "customer_foreign_key_valid") not in failed


def test_checksum_manifest_counts_repeats(spark):
    def manifest(rows):
        sealed = spark.createDataFrame(rows, "k string, sha256 string")
        return governance.checksum_manifest(sealed, "k").first()["checksum"]

    a, b = "a" * 64, "a" * 63 + "b"
    assert manifest([("k", a)] * 2) != manifest([("k", b)] * 2)
    assert manifest([("k", a), ("k", b)]) == manifest([("k", b), ("k", a)])
