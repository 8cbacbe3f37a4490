"""Flat SQL form of the evidence rows and the violations they raise."""

from __future__ import annotations

from registry.oracle import CTES


def evidence(recovered: bool = False) -> str:
    still = "event_id % 5 = 0" if recovered else "true"
    delay = "to_seconds(event_id % 900 + 30)" if recovered else "to_seconds(0)"

    def fault(condition: str) -> str:
        return f"(({condition}) and {still})"

    leak = fault("event_type = 'view' and event_id % 4 < 3")
    bad = fault("event_type = 'error' and value > 40")
    return f"""select *,
      (age1 > 172800 or status1 = 'FAIL') fail1, age2 > 86400 fail2 from (
    select event_id, event_type, ts + {delay} recorded_at,
      case when event_id % 2 = 0 then 'pre' else 'post' end stage,
      case event_type when 'click' then 'schema_break' when 'view' then 'pii_exposure'
        when 'purchase' then 'freshness_breach' when 'error' then 'quality_regression'
        else 'policy_false_positive' end scenario_id,
      case when event_id % 101 = 0 then '' else 'run-' || event_id end run_key,
      event_id % 3 <> 0 promotion,
      {fault('event_id % 17 = 0')} or {fault('event_id % 19 = 0')} no_branch,
      {fault('event_id % 23 = 0')} no_commit, {fault('event_id % 29 = 0')} incomplete,
      {fault('event_id % 37 = 0')} no_resources,
      {fault('event_id % 13 = 0')} dropped, {fault('event_id % 43 = 0')} added,
      {fault('event_id % 47 = 0')} retyped, {leak} leaked,
      event_id % 11 = 0 changed, {fault('event_id % 33 = 0')} unapproved,
      sha256('m' || event_id) manifest_sha256, {bad} bad_quality,
      case when {bad} then event_id % 4 + 1 else 0 end failed_tests,
      case when {still} then cast(cast(value as decimal(12,2)) * 1000 as double) else 0 end age1,
      case when {still} then cast(event_id * 37 % 100000 as double) else 0 end age2,
      case when {fault('event_id % 53 = 0')} then 'FAIL' else 'PASS' end status1,
      {fault('event_id % 59 = 0')} unexplained,
      case when {fault('event_id % 61 = 0')} then 'FAIL' when event_id % 79 = 0 then null
        else 'PASS' end pipeline_status,
      not {fault('event_id % 67 = 0')} canonical_unchanged,
      case when {fault('event_id % 71 = 0')} then 14 else 15 end tables,
      case when {fault('event_id % 73 = 0')} then 2 else 0 end failed_queries
    from events)"""


def _select(policy: str, category: str, reason: str, details: str, condition: str,
            source: str) -> str:
    return (
        f"select event_id, run_key, stage, '{policy}' policy_id, '{category}' category,"
        f" 'deny' severity, {reason} reason, {details} details from {source} where {condition}"
    )


def _number(expr: str) -> str:
    return f"regexp_replace(cast(cast({expr} as decimal(18,3)) as varchar), '\\.?0+$', '')"


def blocking(ev: str) -> str:
    meta = ("PAC-META-001", "metadata")
    schema, pii = ("PAC-SCHEMA-001", "schema_contract"), ("PAC-PRIVACY-001", "schema_contract")
    run = "runtime_validation"
    customer = "governed Gold model gold_customer_order_summary"
    public = "governed Gold model gold_public_sales_dashboard"
    model_c = """'{"model":"gold_customer_order_summary"}'"""
    model_p = """'{"model":"gold_public_sales_dashboard"}'"""

    def breach(name: str, age: str, limit: int, status: str) -> tuple[str, str]:
        reason = (
            f"'freshness threshold breached for {name}: observed_age_seconds=' || {_number(age)}"
            f" || ' maximum_age_seconds={limit} status=' || {status}"
        )
        details = (
            f"""'{{"maximum_age_seconds":{limit}.0,"observed_age_seconds":' || {age} ||
            ',"source":"{name}","source_status":"' || {status} || '"}}'"""
        )
        return reason, details

    first = breach("gold_daily_sales", "age1", 172800, "status1")
    second = breach("silver_orders", "age2", 86400, "'PASS'")
    runtime_reason = (
        "'runtime execution integrity failed: pipeline_status=' || pipeline_status ||"
        " ' canonical_unchanged=' || canonical_unchanged || ' isolated_output_tables=' || tables ||"
        " ' expected_isolated_output_tables=15 athena_failed_queries=' || failed_queries"
    )
    runtime_details = (
        """'{"athena_failed_queries":' || failed_queries || ',"canonical_unchanged":' ||
        canonical_unchanged || ',"expected_isolated_output_tables":15,"isolated_output_tables":' ||
        tables || ',"pipeline_status":"' || pipeline_status || '"}'"""
    )
    rows = [
        (*meta, "'git branch is missing or empty'", "'{}'", "no_branch"),
        (*meta, "'git commit is missing or empty'", "'{}'", "no_commit"),
        (*meta, "'experiment run key is missing or empty'", "'{}'", "run_key = ''"),
        (*meta, "'required governance metadata is incomplete'", "'{}'", "incomplete"),
        (*meta, "'governed resource inventory is empty'", "'{}'", "no_resources"),
        (*schema, f"""'{customer} is missing required columns: ["average_order_value"]'""",
         model_c, "dropped"),
        (*schema, f"""'{customer} contains unexpected contract columns: ["loyalty_tier"]'""",
         model_c, "added"),
        (*schema, f"""'{customer} contains incompatible type changes: """
         """["total_orders: integer to string"]'""", model_c, "retyped"),
        (*schema, f"'{customer} column count mismatch: expected 11, actual ' ||"
         " (11 - dropped::int + added::int)", model_c, "dropped <> added"),
        (*schema, f"""'{public} contains unexpected contract columns: """
         """["synthetic_email", "synthetic_phone"]'""", model_p, "leaked"),
        (*schema, f"'{public} column count mismatch: expected 8, actual 9'", model_p, "leaked"),
        (*pii, """'public Gold output contains governed forbidden columns: """
         """["synthetic_email", "synthetic_phone"]'""",
         """'{"detected_forbidden_columns":["synthetic_email","synthetic_phone"],"""
         """"public_models":["gold_public_sales_dashboard"]}'""", "leaked"),
        ("PAC-TRANSFORM-001", "transformation_definition",
         "'unapproved or out-of-scope governed transformation definitions detected: "
         """["gold_shadow"]'""",
         """'{"changed_models":["gold_daily_sales"],"manifest_sha256":"' || manifest_sha256 ||
         '","unapproved_definitions":["gold_shadow"]}'""",
         "stage = 'pre' and unapproved"),
        ("PAC-QUALITY-001", run,
         "'critical data-quality validation failed: failed_tests=' || failed_tests ||"
         """ ' critical_failures=["test.keys", "test.revenue"]'""",
         """'{"critical_failures":["test.keys","test.revenue"],"failed_tests":' || failed_tests ||
         ',"quality_status":"FAIL","total_tests":41}'""",
         "stage = 'post' and bad_quality"),
        ("PAC-FRESH-001", run, *first, "stage = 'post' and fail1"),
        ("PAC-FRESH-001", run, *second, "stage = 'post' and fail2"),
        ("PAC-FRESH-001", run,
         "'freshness evaluation failed without a source-level freshness failure record'",
         """'{"maximum_age_seconds":0.0,"observed_age_seconds":0.0,"source":"__aggregate__","""
         """"source_status":"FAIL"}'""",
         "stage = 'post' and unexplained and not fail1 and not fail2"),
        ("PAC-RUNTIME-001", run, runtime_reason, runtime_details,
         "stage = 'post' and pipeline_status is not null and (pipeline_status <> 'PASS'"
         " or not canonical_unchanged or tables <> 15 or failed_queries > 0)"),
    ]
    return " union all ".join(_select(*r, ev) for r in rows)


def all_violations(ev: str, blocked: str) -> str:
    release = _select(
        "PAC-RELEASE-001", "release_rule",
        "'promotion requested while blocking policy violations remain unresolved'", "'{}'",
        f"promotion and event_id in (select event_id from {blocked})", ev,
    )
    return f"select * from {blocked} union all {release}"


STAGES = {
    "PAC-META-001": ("metadata", ("pre", "post")),
    "PAC-SCHEMA-001": ("schema_contract", ("pre",)),
    "PAC-PRIVACY-001": ("schema_contract", ("pre", "post")),
    "PAC-TRANSFORM-001": ("transformation_definition", ("pre",)),
    "PAC-RELEASE-001": ("release_rule", ("pre", "post")),
    "PAC-QUALITY-001": ("runtime_validation", ("post",)),
    "PAC-FRESH-001": ("runtime_validation", ("post",)),
    "PAC-RUNTIME-001": ("runtime_validation", ("post",)),
}

CTES["policy_catalog"] = " union all ".join(
    f"select '{p}' policy_id, '{c}' category, '{s}' stage"
    for p, (c, stages) in STAGES.items()
    for s in stages
)
CTES["policy_names"] = "select distinct policy_id, category from policy_catalog"


def _decision(ev: str, violations: str) -> str:
    return f"""select e.event_id, e.run_key, e.scenario_id, e.stage evaluation_stage, e.recorded_at,
      case when v.n is null then 'ALLOW' else 'DENY' end decision, v.n is null allow,
      coalesce(v.n, 0) violation_count, coalesce(v.ids, '') triggered_policy_ids,
      (select count(*) from policy_catalog c where c.stage = e.stage) applicable_policy_count,
      coalesce(v.denied, 0) denied_policy_count, e.promotion promotion_requested,
      e.promotion and v.n is not null promotion_blocked
    from {ev} e left join (select x.event_id, count(*) n,
        string_agg(distinct x.policy_id, ',' order by x.policy_id) ids,
        count(distinct c.policy_id) denied
      from {violations} x left join policy_catalog c
        on c.policy_id = x.policy_id and c.stage = x.stage group by 1) v on v.event_id = e.event_id"""


CTES["ev"] = evidence()
CTES["blocked"] = blocking("ev")
CTES["violated"] = all_violations("ev", "blocked")
CTES["decided"] = _decision("ev", "violated")
CTES["ev_after"] = evidence(recovered=True)
CTES["blocked_after"] = blocking("ev_after")
CTES["violated_after"] = all_violations("ev_after", "blocked_after")
CTES["decided_after"] = _decision("ev_after", "violated_after")

CTES["remedies"] = """
select 'freshness_breach' scenario_id, 'retry' primary_action, 'quarantine' fallback_action,
  2 max_attempts, 300 timeout_seconds, 'isolated_output' target_scope, 'post' detection_stage,
  true automatic, ['freshness', 'runtime', 'release_policy'] verification
union all select 'pii_exposure', 'redact_republish', 'quarantine', 1, 300,
  'isolated_public_candidate', 'pre', true, ['privacy', 'schema_contract', 'release_policy']
union all select 'policy_false_positive', 'manual_review', 'stop_promotion', 0, 0, 'release_state',
  'pre', false, ['manual_policy_review']
union all select 'quality_regression', 'rollback', 'quarantine', 1, 300, 'isolated_output', 'post',
  true, ['quality', 'runtime', 'release_policy']
union all select 'schema_break', 'rollback', 'manual_review', 1, 300, 'isolated_release_candidate',
  'pre', true, ['schema_contract', 'release_policy']"""
CTES["judged"] = """
select d.*, r.* exclude (scenario_id), case when run_key = '' then 'run_key_missing'
  when evaluation_stage <> detection_stage then 'stage_mismatch'
  when decision <> 'DENY' then 'not_denied'
  when not promotion_requested then 'promotion_not_requested' end reject_reason
from decided d join remedies r on r.scenario_id = d.scenario_id"""
CTES["plans"] = "select * from judged where reject_reason is null"
CTES["check_policies"] = """
select 'schema_contract' check_name, 'PAC-SCHEMA-001' policy_id
union all select 'privacy', 'PAC-PRIVACY-001' union all select 'freshness', 'PAC-FRESH-001'
union all select 'quality', 'PAC-QUALITY-001' union all select 'runtime', 'PAC-RUNTIME-001'
union all select 'release_policy', 'PAC-RELEASE-001'"""
CTES["checked"] = """
select p.event_id, p.run_key, p.scenario_id, p.check_name, c.policy_id,
  case when p.check_name = 'manual_policy_review' then 'PENDING'
    when exists (select 1 from violated_after v where v.event_id = p.event_id
      and v.policy_id = c.policy_id) then 'FAIL' else 'PASS' end status
from (select event_id, run_key, scenario_id, unnest(verification) check_name from plans) p
left join check_policies c on c.check_name = p.check_name"""
CTES["verified"] = """
select p.event_id, p.run_key, p.scenario_id, p.fallback_action,
  case when not p.automatic then 'PENDING' when a.allow and not exists (select 1 from checked c
    where c.event_id = p.event_id and c.status <> 'PASS') then 'PASS' else 'FAIL' end
    verification_status,
  p.recorded_at fault_at, a.recorded_at completed_at
from plans p join decided_after a on a.event_id = p.event_id"""
CTES["routed"] = """
select *, case when fallback_action = 'quarantine' and matching_violations = 1 then 'QUARANTINED'
    when fallback_action = 'quarantine' then 'REFUSED'
    when fallback_action = 'manual_review' then 'MANUAL_REVIEW' else 'PROMOTION_STOPPED' end
    terminal_state
from (select v.event_id, v.run_key, v.scenario_id, v.fallback_action, q.policy_id, q.policy_category,
    case when v.fallback_action = 'quarantine' then (select count(*) from violated_after x
      where x.event_id = v.event_id and x.policy_id = q.policy_id) end matching_violations
  from verified v left join (
    select 'pii_exposure' scenario_id, 'PAC-PRIVACY-001' policy_id, 'privacy' policy_category
    union all select 'freshness_breach', 'PAC-FRESH-001', 'freshness'
    union all select 'quality_regression', 'PAC-QUALITY-001', 'quality') q
    on q.scenario_id = v.scenario_id
  where v.verification_status <> 'PASS')"""
