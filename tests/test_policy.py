"""Every policy branch: silent on a safe input, raised by its fault, and the stage rules."""

import copy
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators import evidence, policy, remediation
from tidelake.sources.schemas import FRESHNESS_CONTROL_SCHEMA, POLICY_INPUT_SCHEMA

SCHEMA = T.StructType([*POLICY_INPUT_SCHEMA.fields, T.StructField("recorded_at", T.TimestampType())])

SAFE = {
    "schema_version": "1.0.0",
    "evaluation_stage": "post",
    "experiment": {"condition": "C2", "scenario_id": "freshness_breach", "run_key": "r1"},
    "controls": {
        "policy_as_code_required": True,
        "self_healing_permitted": True,
        "automatic_remediation_permitted": True,
    },
    "git": {"branch": "main", "commit": "abc"},
    "release": {"target_layer": "gold", "promotion_requested": True},
    "metadata": {"required_fields_present": True, "resource_count": 15},
    "schema_contract": {
        "governed_models": [
            {
                "model": "m",
                "exposure": "internal",
                "expected_column_count": 11,
                "actual_column_count": 11,
                "missing_columns": [],
                "unexpected_columns": [],
                "incompatible_type_changes": [],
            }
        ]
    },
    "transformation": {"changed_models": [], "unapproved_definitions": [], "manifest_sha256": "s"},
    "privacy": {"public_models": ["p"], "forbidden_columns": [], "detected_forbidden_columns": []},
    "quality": {"status": "PASS", "total_tests": 41, "failed_tests": 0, "critical_failures": []},
    "freshness": {
        "status": "PASS",
        "sources": [
            {
                "source": "s",
                "observed_age_seconds": 10.0,
                "maximum_age_seconds": 86400.0,
                "status": "PASS",
            }
        ],
    },
    "runtime": {
        "pipeline_status": "PASS",
        "canonical_unchanged": True,
        "isolated_output_tables": 15,
        "athena_failed_queries": 0,
    },
    "recorded_at": datetime(2024, 1, 1),
}


def changed(**paths):
    row = copy.deepcopy(SAFE)
    for path, value in paths.items():
        *parents, last = path.split("__")
        target = row
        for parent in parents:
            target = target[int(parent)] if isinstance(target, list) else target[parent]
        target[last] = value
    return row


def evaluated(spark, *rows):
    return policy.evaluate(spark.createDataFrame(list(rows), SCHEMA))


def raised(spark, *rows):
    found = policy.violations_table(evaluated(spark, *rows)).orderBy("policy_id", "reason")
    return [(r["policy_id"], r["reason"]) for r in found.collect()]


MODEL = "schema_contract__governed_models__0__"
SOURCE = "freshness__sources__0__"
BREACH = "freshness threshold breached for s: observed_age_seconds={} maximum_age_seconds=86400 status={}"
RUNTIME = (
    "runtime execution integrity failed: pipeline_status={} canonical_unchanged={}"
    " isolated_output_tables={} expected_isolated_output_tables=15 athena_failed_queries={}"
)
CASES = [
    ({}, []),
    ({"git__branch": ""}, ["git branch is missing or empty"]),
    ({"git__branch": None}, ["git branch is missing or empty"]),
    ({"git__commit": None}, ["git commit is missing or empty"]),
    ({"experiment__run_key": ""}, ["experiment run key is missing or empty"]),
    ({"metadata__required_fields_present": False}, ["required governance metadata is incomplete"]),
    ({"metadata__required_fields_present": None}, []),
    ({"metadata__resource_count": 0}, ["governed resource inventory is empty"]),
    ({"metadata__resource_count": None}, []),
    (
        {"transformation__unapproved_definitions": ["x"], "evaluation_stage": "pre"},
        ['unapproved or out-of-scope governed transformation definitions detected: ["x"]'],
    ),
    ({"transformation__unapproved_definitions": ["x"]}, []),
    (
        {"privacy__detected_forbidden_columns": ["synthetic_email"]},
        ['public Gold output contains governed forbidden columns: ["synthetic_email"]'],
    ),
    (
        {"quality__status": "FAIL", "quality__failed_tests": 1, "quality__critical_failures": ["t"]},
        ['critical data-quality validation failed: failed_tests=1 critical_failures=["t"]'],
    ),
    ({"quality__status": "FAIL", "evaluation_stage": "pre"}, []),
    ({SOURCE + "observed_age_seconds": 86400.0}, []),
    ({SOURCE + "observed_age_seconds": 86401.0}, [BREACH.format(86401, "PASS")]),
    ({SOURCE + "status": "FAIL"}, [BREACH.format(10, "FAIL")]),
    ({SOURCE + "status": "FAIL", "freshness__status": "FAIL"}, [BREACH.format(10, "FAIL")]),
    (
        {"freshness__status": "FAIL"},
        ["freshness evaluation failed without a source-level freshness failure record"],
    ),
    ({"freshness__status": "FAIL", "evaluation_stage": "pre"}, []),
    ({"runtime__pipeline_status": "FAIL"}, [RUNTIME.format("FAIL", "true", 15, 0)]),
    ({"runtime__canonical_unchanged": False}, [RUNTIME.format("PASS", "false", 15, 0)]),
    ({"runtime__isolated_output_tables": 14}, [RUNTIME.format("PASS", "true", 14, 0)]),
    ({"runtime__athena_failed_queries": 1}, [RUNTIME.format("PASS", "true", 15, 1)]),
    ({"runtime__athena_failed_queries": 1, "evaluation_stage": "pre"}, []),
    ({"runtime__pipeline_status": None, "runtime__athena_failed_queries": 1}, []),
    (
        {MODEL + "missing_columns": ["c11"], MODEL + "actual_column_count": 10},
        [
            "governed Gold model m column count mismatch: expected 11, actual 10",
            'governed Gold model m is missing required columns: ["c11"]',
        ],
    ),
    (
        {MODEL + "unexpected_columns": ["c12"], MODEL + "actual_column_count": 12},
        [
            "governed Gold model m column count mismatch: expected 11, actual 12",
            'governed Gold model m contains unexpected contract columns: ["c12"]',
        ],
    ),
    (
        {MODEL + "incompatible_type_changes": ["a: integer to string"]},
        ['governed Gold model m contains incompatible type changes: ["a: integer to string"]'],
    ),
]


def test_rule_branches(spark):
    """Each case once without and once with a promotion request."""
    rows = []
    for number, (faults, _) in enumerate(CASES):
        for promoted in (False, True):
            row = changed(**faults, release__promotion_requested=promoted)
            row["schema_version"] = f"{number}-{promoted}"
            rows.append(row)
    found = evaluated(spark, *rows).select("schema_version", "violations.reason").collect()
    got = {r[0]: sorted(r[1]) for r in found}
    release = "promotion requested while blocking policy violations remain unresolved"
    for number, (_, reasons) in enumerate(CASES):
        assert got[f"{number}-False"] == sorted(reasons)
        assert got[f"{number}-True"] == sorted(reasons + [release] * bool(reasons))


def test_violations_are_a_set(spark):
    model = SAFE["schema_contract"]["governed_models"][0] | {"missing_columns": ["a"]}
    row = changed(schema_contract__governed_models=[model, copy.deepcopy(model)])
    assert len([p for p, _ in raised(spark, row) if p == "PAC-SCHEMA-001"]) == 1


def test_outcomes_and_guard_row(spark):
    row = changed(**{MODEL + "missing_columns": ["a"], "release__promotion_requested": False})
    found = policy.policy_outcomes(evaluated(spark, row)).collect()
    got = {r["policy_id"]: r["outcome"] for r in found}
    assert len(got) == len(policy.POLICY_CATALOG)
    assert got["PAC-SCHEMA-001"] == "OUT_OF_STAGE"
    assert got["PAC-TRANSFORM-001"] == "NOT_APPLICABLE"
    assert got["PAC-META-001"] == "PASS"


def test_decisions(spark):
    allowed, denied = changed(), changed(quality__status="FAIL", experiment__run_key="r2")
    got = {r["run_key"]: r for r in policy.decisions(evaluated(spark, allowed, denied)).collect()}
    assert got["r1"]["decision"] == "ALLOW" and not got["r1"]["promotion_blocked"]
    assert got["r2"]["triggered_policy_ids"] == ["PAC-QUALITY-001", "PAC-RELEASE-001"]
    assert got["r2"]["promotion_blocked"] and got["r2"]["denied_policy_count"] == 2
    assert got["r2"]["applicable_policy_count"] == 6


def test_positional_schema_differences(spark):
    def lists(**models):
        rows = [(m, i, c) for m, cols in models.items() for i, c in enumerate(cols, start=1)]
        return spark.createDataFrame(rows, "model string, position int, column_name string")

    expected = lists(m="abcd", tail="ab", grown="ab", same="ab")
    current = lists(m="acd", tail="a", grown="abc", same="ab")
    found = evidence.schema_differences(expected, current).collect()
    got = {}
    for r in found:
        got.setdefault((r["model"], r["side"]), set()).add(r["column_name"])
    assert got == {
        ("m", "missing"): {"b", "c", "d"},
        ("m", "unexpected"): {"c", "d"},
        ("tail", "missing"): {"b"},
        ("grown", "unexpected"): {"c"},
    }


def test_freshness_boundaries_and_rejects(spark):
    def row(name, hours_ahead, seconds=0, status="PASS", slo=24.0, actual=datetime(2024, 1, 1)):
        expected = datetime.fromtimestamp(
            datetime(2024, 1, 1).timestamp() + hours_ahead * 3600 + seconds
        )
        return (name, expected, actual, slo, status, "r")

    rows = [
        row("limit", 24),
        row("over", 24, 1),
        row("flagged", 1, status=" fail "),
        row("late", -5),
        row("copy", 1),
        row(" copy ", 1),
        row(" ", 1),
        row("odd", 1, status="maybe"),
        row("unread", 1, actual=None),
        row("negative", 1, slo=-1.0),
        row("no slo", 1, slo=None),
    ]
    control = spark.createDataFrame(rows, FRESHNESS_CONTROL_SCHEMA)
    found = evidence.freshness_evidence(control).collect()
    states = {r["source"]: (r["status"], r["observed_age_seconds"], r["reject_reason"]) for r in found}
    assert states["limit"] == ("PASS", 86400.0, None)
    assert states["over"] == ("FAIL", 86401.0, None)
    assert states["flagged"] == ("FAIL", 3600.0, None)
    assert states["late"] == ("PASS", 0.0, None)
    rejects = {s: v[2] for s, v in states.items() if v[2]}
    assert rejects == {
        "copy": "duplicate dataset",
        "": "empty dataset_name",
        "odd": "bad status",
        "unread": "bad timestamp",
        "negative": "slo negative",
        "no slo": "slo not numeric",
    }
    late = [r for r in found if r["source"] == "late"][0]
    assert late["lateness_seconds"] == 18000.0


def test_eligibility_reasons_and_plan(spark):
    bad = {"quality__status": "FAIL"}
    rows = [
        changed(**bad, experiment__run_key="plan"),
        changed(**bad, experiment__run_key=" "),
        changed(**bad, experiment__run_key="scenario", experiment__scenario_id="other"),
        changed(**bad, experiment__run_key="stage", experiment__scenario_id="schema_break"),
        changed(experiment__run_key="fine"),
        changed(**bad, experiment__run_key="quiet", release__promotion_requested=False),
    ]
    judged = remediation.eligibility(policy.decisions(evaluated(spark, *rows)))
    reasons = {r["run_key"]: r["reject_reason"] for r in judged.collect()}
    assert reasons == {
        "plan": None,
        " ": "run_key_missing",
        "scenario": "scenario_unknown",
        "stage": "stage_mismatch",
        "fine": "not_denied",
        "quiet": "promotion_not_requested",
    }
    plan = remediation.remediation_plans(judged).collect()
    assert [(p["run_key"], p["primary_action"], p["max_attempts"]) for p in plan] == [
        ("plan", "retry", 2)
    ]


def test_recovery_and_fallback(spark):
    def run(key, scenario, **faults):
        stage = {"pii_exposure": "pre", "schema_break": "pre", "policy_false_positive": "pre"}
        return changed(
            experiment__run_key=key,
            experiment__scenario_id=scenario,
            evaluation_stage=stage.get(scenario, "post"),
            **faults,
        )

    stale = {SOURCE + "observed_age_seconds": 90000.0}
    leak = {"privacy__detected_forbidden_columns": ["e"]}
    lost = {MODEL + "missing_columns": ["a"]}
    before = [
        run("healed", "freshness_breach", **stale),
        run("stuck", "freshness_breach", **stale),
        run("mixed", "freshness_breach", **stale),
        run("leak", "pii_exposure", **leak),
        run("schema", "schema_break", **lost),
        run("safe", "policy_false_positive", **lost),
    ]
    after = [
        run("healed", "freshness_breach"),
        run("stuck", "freshness_breach", **stale),
        run("mixed", "freshness_breach", git__branch=""),
        run("leak", "pii_exposure", **leak),
        run("schema", "schema_break", **lost),
        run("safe", "policy_false_positive", **lost),
    ]
    for row in after:
        row["recorded_at"] = datetime(2024, 1, 1, 0, 0, 30)
    plans = remediation.remediation_plans(
        remediation.eligibility(policy.decisions(evaluated(spark, *before)))
    )
    recovered = policy.decisions(evaluated(spark, *after))
    checks = remediation.check_results(plans, recovered).collect()
    by_run = {}
    for c in checks:
        by_run.setdefault(c["run_key"], {})[c["check_name"]] = c["status"]
    assert by_run["healed"] == {"freshness": "PASS", "runtime": "PASS", "release_policy": "PASS"}
    assert by_run["stuck"]["freshness"] == "FAIL"
    assert by_run["safe"] == {"manual_policy_review": "PENDING"}
    verified = remediation.verify_recovery(plans, recovered)
    got = {r["run_key"]: r for r in verified.collect()}
    assert got["healed"]["terminal_state"] == "RECOVERED"
    assert got["healed"]["recovery_time_ms"] == 30000.0
    assert got["stuck"]["verification_status"] == "FAIL"
    assert got["safe"]["verification_status"] == "PENDING"
    routes = {r["run_key"]: r["terminal_state"] for r in remediation.fallback_routes(verified).collect()}
    assert routes == {
        "stuck": "QUARANTINED",
        "mixed": "REFUSED",
        "leak": "QUARANTINED",
        "schema": "MANUAL_REVIEW",
        "safe": "PROMOTION_STOPPED",
    }


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        ({"evidence_uri": None}, "missing_field"),
        ({"condition": "C1"}, "condition_not_accepted"),
        ({"scenario_id": "schema_break"}, "scenario_not_eligible"),
        ({"source_bucket": "other"}, "bucket_mismatch"),
        ({"source_key": "silver/x"}, "outside_source_boundary"),
        ({"source_key": "experiments/c2/../x"}, "path_traversal"),
        ({"retry_count": 3}, "retry_count_out_of_bounds"),
        ({"max_retries": -1}, "max_retries_out_of_bounds"),
        ({"retry_count": 2, "max_retries": 1}, "retry_count_above_max"),
        ({"detected_at": "soon"}, "bad_timestamp"),
    ],
)
def test_quarantine_requests(spark, change, reason):
    requests = request_frame(spark, [change])
    assert remediation.validate_requests(requests, "lake").first()["reject_reason"] == reason


def request_frame(spark, changes):
    base = {f: "x" for f in remediation.REQUEST_FIELDS} | {
        "condition": "C2",
        "run_id": "run 1",
        "scenario_id": "pii_exposure",
        "source_bucket": "lake",
        "source_key": "experiments/c2/a/part 0.parquet",
        "detected_at": "2024-01-01T00:00:00Z",
        "retry_count": 0,
        "max_retries": 2,
    }
    kinds = {"retry_count": "int", "max_retries": "int"}
    schema = ", ".join(f"{f} {kinds.get(f, 'string')}" for f in remediation.REQUEST_FIELDS)
    return spark.createDataFrame(
        [tuple((base | c)[f] for f in remediation.REQUEST_FIELDS) for c in changes], schema
    )


def test_quarantine_event_replay_adds_nothing(spark, tmp_path):
    requests = request_frame(spark, [{}, {"run_id": "run 2"}, {}])
    events = remediation.quarantine_events(requests, F.current_timestamp(), "lake")
    assert len(events.columns) == 23
    path = str(tmp_path / "events")
    assert remediation.append_events(events, path).count() == 2
    assert remediation.append_events(events, path).count() == 2
    row = events.where("run_id = 'run 1'").first()
    assert row["quarantine_event_id"].startswith("c2-q-") and len(row["quarantine_event_id"]) == 29
    assert row["rejected_output_location"] == (
        "s3://lake/quarantine/objects/pii_exposure/run-1/part-0.parquet"
    )


def test_experiment_metrics_censor_unverified_runs(spark):
    rows = [
        ("C2", True, True, True, False, 10.0, "RECOVERED", "PASS", 100.0),
        ("C2", True, True, True, False, 20.0, "RECOVERED", "PASS", 300.0),
        ("C2", True, False, False, True, 30.0, "QUARANTINED", "FAIL", 999.0),
        ("C2", False, True, True, True, 40.0, "PROMOTION_STOPPED", "PENDING", None),
    ]
    runs = spark.createDataFrame(
        rows,
        "condition string, unsafe boolean, prevented boolean, denied boolean, manual boolean,"
        " treatment_seconds double, final_state string, verification_status string,"
        " recovery_seconds double",
    )
    got = remediation.experiment_metrics(runs, "condition").first().asDict()
    assert got["unsafe_prevented_pct"] == 66.67 and got["escape_pct"] == 33.33
    assert got["false_positive_pct"] == 100.0 and got["manual_pct"] == 50.0
    assert got["mttr_seconds"] == 200.0 and got["mttr_sample_sd"] == 141.421
    assert got["verified_recoveries"] == 2 and got["mean_treatment_seconds"] == 25.0


def test_last_verified_version_comes_back(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(Exception):
        remediation.rollback(spark, root, "d", 1)
    good = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    remediation.write_version(good, root, "d", 1, "PASS")
    remediation.write_version(good.where("x = 1"), root, "d", 2, "FAIL")
    result = remediation.rollback(spark, root, "d", 3).first()
    assert tuple(result) == ("d", 1, 2, True)
    assert remediation.last_verified(spark, root, "d")["version"] == 3


def test_deleted_definitions_are_changes(spark):
    schema = "model string, definition_sha256 string"
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], schema)
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], schema)
    approved = spark.createDataFrame([("c",)], "model string")
    rows = evidence.definition_changes(old, new, approved).collect()
    assert {tuple(r) for r in rows} == {
        ("b", "changed", True), ("c", "deleted", False), ("d", "added", True),
    }


def test_a_run_without_an_input_is_rejected(spark):
    pipeline = spark.createDataFrame([(1, "PASS", True), (2, "PASS", True)],
                                     "run long, pipeline_result string, pipeline_success boolean")
    canonical = spark.createDataFrame([(1, "PASS", False)],
                                      "run long, canonical_result string, canonical_changed boolean")
    tables = spark.createDataFrame([(1, 3), (2, 3)], "run long, total_tables long")
    queries = spark.createDataFrame([(1, 0), (3, 0)], "run long, failed_query_count long")
    rows = evidence.runtime_evidence(pipeline, canonical, tables, queries, "run").collect()
    got = {r["run"]: (r["pipeline_status"], r["reject_reason"]) for r in rows}
    assert got == {
        1: ("PASS", None),
        2: ("FAIL", "missing canonical, queries"),
        3: ("FAIL", "missing pipeline, canonical, inventory"),
    }
