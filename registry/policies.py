"""Evidence and policy evaluation (inventory J)."""

from __future__ import annotations

from pyspark.sql import functions as F

import registry.policy_oracle  # noqa: F401  registers its SQL fragments
from registry import query
from registry.oracle import sql
from tidelake.operators import contracts, evidence, policy
from tidelake.plans import rules
from tidelake.sources.testdata import policy_inputs, table

_NAMES = list(rules.GOLD_COLUMNS)
_EXPECTED_SQL = "[" + ", ".join(
    "[" + ", ".join(f"'{c}'" for c in rules.GOLD_COLUMNS[n]) + "]" for n in _NAMES) + "]"

# One model version per event: an event's model has the columns of one Gold dataset, with
# one of them dropped, added or left out at the end, depending on the event.
_MODELS_SQL = f"""(select event_id % 5 kind, 'm' || event_id model, event_id,
  {_EXPECTED_SQL}[event_id % 5 + 1] expected from events)"""
_CURRENT_SQL = """case event_id % 4 when 0 then expected
  when 1 then list_concat(expected[:event_id % 3 + 1], expected[event_id % 3 + 3:])
  when 2 then list_concat(expected, ['synthetic_email']) else expected[:len(expected) - 1] end"""
_PAIRS_SQL = f"""(select model, event_id, kind,
    unnest(range(1, greatest(len(expected), len(cur)) + 1)) p, expected, cur
  from (select *, {_CURRENT_SQL} cur from {_MODELS_SQL}))"""
_DIFF_SQL = f"""(select distinct model, side, column_name from (
    select model, 'missing' side, expected[p] column_name from {_PAIRS_SQL}
      where expected[p] is distinct from cur[p]
    union all select model, 'unexpected', cur[p] from {_PAIRS_SQL}
      where expected[p] is distinct from cur[p]) where column_name is not null)"""


def _column_lists(spark, sf_dir):
    """(expected, current) column lists, long form: model, position, column_name."""
    lists = F.array(
        *[F.array(*[F.lit(c) for c in rules.GOLD_COLUMNS[n]]) for n in _NAMES]
    )
    kind = (F.col("event_id") % 5).cast("int")
    models = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("m"), F.col("event_id")).alias("model"),
        F.element_at(lists, kind + 1).alias("expected"),
    )
    cut = (F.col("event_id") % 3).cast("int")
    size = F.size("expected")
    current = (
        F.when(F.col("event_id") % 4 == 0, F.col("expected"))
        .when(
            F.col("event_id") % 4 == 1,
            F.concat(
                F.slice("expected", F.lit(1), cut + 1),
                F.slice("expected", cut + 3, F.greatest(size - cut - 2, F.lit(0))),
            ),
        )
        .when(
            F.col("event_id") % 4 == 2, F.concat("expected", F.array(F.lit("synthetic_email")))
        )
        .otherwise(F.slice("expected", F.lit(1), size - 1))
    )
    models = models.withColumn("current", current)

    def long_form(column: str):
        return models.select("model", F.posexplode(column).alias("p", "column_name")).select(
            "model", (F.col("p") + 1).alias("position"), "column_name"
        )

    return long_form("expected"), long_form("current")


@query("j1_schema_differences", f"select * from {_DIFF_SQL}")
def schema_differences(spark, sf_dir):
    return evidence.schema_differences(*_column_lists(spark, sf_dir))


@query(
    "j1_schema_evidence",
    f"""select m.model, len(m.expected)::bigint expected_column_count,
      len(m.cur)::bigint actual_column_count,
      (select count(*) from {_DIFF_SQL} d where d.model = m.model and side = 'missing') missing_columns,
      (select count(*) from {_DIFF_SQL} d where d.model = m.model and side = 'unexpected')
        unexpected_columns
    from (select *, {_CURRENT_SQL} cur from {_MODELS_SQL}) m""",
)
def schema_evidence(spark, sf_dir):
    return evidence.schema_evidence(*_column_lists(spark, sf_dir))


@query(
    "j2_privacy_evidence",
    f"""select distinct model, c column_name from (select model, event_id, unnest(cur) c
        from (select *, {_CURRENT_SQL} cur from {_MODELS_SQL}))
      where event_id % 5 = 4 and (c in ({', '.join(f"'{c}'" for c in contracts.FORBIDDEN_PUBLIC_COLUMNS)})
        or regexp_matches(c, 'email|phone|address|zip_code|postal|consent'))""",
)
def privacy_evidence(spark, sf_dir):
    _, current = _column_lists(spark, sf_dir)
    number = F.substring("model", 2, 20).cast("bigint")
    exposed = F.when(number % 5 == 4, "public").otherwise("internal")
    return evidence.privacy_evidence(current.withColumn("exposure", exposed))


@query(
    "j3_inventory_evidence",
    """select count(*) filter (where e is not null and f is not null) resource_count,
      count(*) filter (where f is null) missing_models,
      count(*) filter (where e is null) unexpected_models,
      count(*) filter (where f is null) = 0 and count(*) filter (where e is not null
        and f is not null and not complete) = 0 required_fields_present
    from (select distinct user_id e from events where event_type = 'click')
    full join (select user_id f, bool_and(props is not null) complete from events
      where event_type = 'view' group by 1) on e = f""",
)
def inventory_evidence(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    expected = events.where("event_type = 'click'").selectExpr("cast(user_id as string) model")
    found = (
        events.where("event_type = 'view'")
        .groupBy(F.col("user_id").cast("string").alias("model"))
        .agg(F.max("props").alias("schema"))
    )
    return evidence.inventory_evidence(expected, found, ["schema"])


@query(
    "j4_definition_changes",
    """select coalesce(c.model, b.model) model,
      case when b.model is null then 'added' when c.model is null then 'deleted' else 'changed' end change,
      coalesce(c.model, b.model) not in (select 'part-' || p_partkey from part where p_size > 25) unapproved
    from (select 'part-' || p_partkey model, sha256(p_name || case when p_size % 3 = 0 then '!'
        else '' end) d from part where p_partkey % 11 <> 0) c
    full join (select 'part-' || p_partkey model, sha256(p_name) d from part where p_type <> 'PROMO') b
      on b.model = c.model
    where b.d is distinct from c.d""",
)
def definition_changes(spark, sf_dir):
    """Part names stand in for definitions; some changed, some are new, some deleted."""
    parts = table(spark, sf_dir, "part")
    model = F.concat(F.lit("part-"), F.col("p_partkey")).alias("model")
    edited = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "!").otherwise(""))
    current = parts.where("p_partkey % 11 <> 0").select(model, F.sha2(edited, 256).alias("definition_sha256"))
    baseline = parts.where("p_type <> 'PROMO'").select(
        model, F.sha2("p_name", 256).alias("definition_sha256")
    )
    approved = parts.where("p_size > 25").select(model)
    return evidence.definition_changes(baseline, current, approved)


def _run_results(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 6 == 0, "model.").otherwise("test.")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.concat(kind, F.col("event_type"), (F.col("event_id") % 10).cast("string")).alias("unique_id"),
        F.expr(
            "case when event_id % 7 = 0 then 'fail' when event_id % 31 = 0 then null else 'pass' end"
        ).alias("status"),
    )


_RESULTS_SQL = """(select user_id run_id, case when event_id % 6 = 0 then 'model.' else 'test.' end
    || event_type || (event_id % 10) unique_id, case when event_id % 7 = 0 then 'fail'
    when event_id % 31 = 0 then null else 'pass' end status from events)"""


@query(
    "j5_quality_evidence",
    f"""select run_id, count(*) total_tests,
      count(*) filter (where status is distinct from 'pass') failed_tests,
      count(distinct unique_id) filter (where status is distinct from 'pass') failing_ids,
      case when count(*) filter (where status is distinct from 'pass') > 0 then 'FAIL' else 'PASS' end
        status
    from {_RESULTS_SQL} where starts_with(unique_id, 'test.') group by 1""",
)
def quality_evidence(spark, sf_dir):
    return evidence.quality_evidence(_run_results(spark, sf_dir), "run_id")


@query(
    "j5_failing_tests",
    f"""select distinct run_id, unique_id from {_RESULTS_SQL}
    where starts_with(unique_id, 'test.') and status is distinct from 'pass'""",
)
def failing_tests(spark, sf_dir):
    return evidence.failing_tests(_run_results(spark, sf_dir), "run_id")


_CONTROL_SPARK = {
    "dataset_name": "case when event_id % 97 = 0 then ' ' when event_id % 89 = 0 then 'copy'"
    " else concat(' ', event_type, event_id, ' ') end",
    "freshness_status": "case when event_id % 83 = 0 then 'late' when event_id % 10 = 0 then 'fail'"
    " else 'pass ' end",
    "expected_publish_time": "cast(timestampadd(HOUR, cast(event_id % 60 as int) - 6, ts) as timestamp)",
    "actual_publish_time": "if(event_id % 71 = 0, null, cast(ts as timestamp))",
    "freshness_slo_hours": "case when event_id % 61 = 0 then -1.0D when event_id % 59 = 0 then null"
    " else 24.0D end",
}


@query(
    "j6_freshness_evidence",
    """select source, case when r is null then greatest(0.0, ahead) end observed_age_seconds,
      case when r is null then slo * 3600 end maximum_age_seconds,
      case when r is null then -ahead end lateness_seconds,
      case when r is null then case when st = 'FAIL' or greatest(0.0, ahead) > slo * 3600
        then 'FAIL' else 'PASS' end end status, r reject_reason
    from (select *, case when source = '' then 'empty dataset_name' when n > 1 then 'duplicate dataset'
        when st not in ('PASS', 'FAIL') then 'bad status' when actual is null then 'bad timestamp'
        when slo is null then 'slo not numeric' when slo < 0 then 'slo negative' end r
      from (select *, count(*) over (partition by source) n from (
        select trim(case when event_id % 97 = 0 then ' ' when event_id % 89 = 0 then 'copy'
            else event_type || event_id end) source,
          case when event_id % 83 = 0 then 'LATE' when event_id % 10 = 0 then 'FAIL' else 'PASS' end st,
          cast((event_id % 60 - 6) * 3600 as double) + case when event_id % 71 = 0 then null else 0.0 end ahead,
          case when event_id % 71 = 0 then null else ts end actual,
          case when event_id % 61 = 0 then -1.0::double when event_id % 59 = 0 then null
            else 24.0::double end slo
        from events)))""",
)
def freshness_evidence(spark, sf_dir):
    control = table(spark, sf_dir, "events").select(
        *[F.expr(e).alias(n) for n, e in _CONTROL_SPARK.items()]
    )
    return evidence.freshness_evidence(control)


@query(
    "j7_runtime_evidence",
    """select run_id, case when run_id % 3 <> 0 and run_id % 5 <> 0 and lacking = '' then 'PASS'
        else 'FAIL' end pipeline_status,
      run_id % 13 <> 0 and run_id % 4 <> 0 and run_id % 7 <> 0 canonical_unchanged,
      case when run_id % 17 <> 0 then run_id % 16 end isolated_output_tables,
      case when run_id % 19 <> 0 then run_id % 2 end athena_failed_queries,
      case when lacking <> '' then 'missing ' || lacking end reject_reason
    from (select event_id run_id, concat_ws(', ', case when event_id % 13 = 0 then 'canonical' end,
        case when event_id % 17 = 0 then 'inventory' end,
        case when event_id % 19 = 0 then 'queries' end) lacking from events)""",
)
def runtime_evidence(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_id", "run_id")
    pipeline = events.selectExpr(
        "run_id", "if(run_id % 3 = 0, 'FAIL', 'PASS') pipeline_result",
        "run_id % 5 <> 0 pipeline_success",
    )
    canonical = events.where("run_id % 13 <> 0").selectExpr(
        "run_id", "if(run_id % 4 = 0, 'FAIL', 'PASS') canonical_result",
        "run_id % 7 = 0 canonical_changed",
    )
    inventory = events.where("run_id % 17 <> 0").selectExpr("run_id", "run_id % 16 total_tables")
    queries = events.where("run_id % 19 <> 0").selectExpr("run_id", "run_id % 2 failed_query_count")
    return evidence.runtime_evidence(pipeline, canonical, inventory, queries, "run_id")


@query(
    "j8_policy_input_assembly",
    """select event_id, case when event_id % 2 = 1 then '' else 'quality,freshness,runtime' end missing_sections,
      case when event_id % 2 = 1 and event_id % 6 = 1 then 'notes' else '' end unexpected_sections
    from events""",
)
def policy_input_assembly(spark, sf_dir):
    """Pre-stage runs lack the post evidence; some post runs carry a section too many."""
    keyed = _with_event_id(spark, sf_dir)
    identity = keyed.select("event_id", "schema_version", "evaluation_stage", "experiment", "controls")
    pre = keyed.select(
        "event_id", "git", "release", "metadata", "schema_contract", "transformation", "privacy"
    )
    post = keyed.where("evaluation_stage = 'post'").select(
        "event_id", "quality", "freshness", "runtime",
        F.when(F.col("event_id") % 6 == 1, F.lit("free text")).alias("notes"),
    )
    assembled = evidence.assemble_inputs(identity, pre, post, "event_id", policy.SECTIONS)
    return assembled.select(
        "event_id",
        F.array_join("missing_sections", ",").alias("missing_sections"),
        F.array_join("unexpected_sections", ",").alias("unexpected_sections"),
    )


def _with_event_id(spark, sf_dir):
    """Policy inputs keyed by event: the transformation manifest digest names the event."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.sha2(F.concat(F.lit("m"), F.col("event_id")), 256).alias("_digest")
    )
    inputs = policy_inputs(spark, sf_dir)
    return inputs.join(
        events, inputs["transformation.manifest_sha256"] == events["_digest"]
    ).drop("_digest")


def _evaluated(spark, sf_dir, recovered: bool = False):
    return policy.evaluate(policy_inputs(spark, sf_dir, recovered))


_RULES = {
    "j9_metadata_rule": "PAC-META-001",
    "j10_schema_rule": "PAC-SCHEMA-001",
    "j11_privacy_rule": "PAC-PRIVACY-001",
    "j12_transformation_rule": "PAC-TRANSFORM-001",
    "j13_quality_rule": "PAC-QUALITY-001",
    "j14_freshness_rule": "PAC-FRESH-001",
    "j15_runtime_rule": "PAC-RUNTIME-001",
}
_COLUMNS = "run_key, stage, policy_id, category, severity, reason, details"

for _name, _policy in _RULES.items():
    query(_name, sql(f"select {_COLUMNS} from violated where policy_id = '{_policy}'"))(
        lambda spark, sf_dir, p=_policy: policy.violations_table(
            policy.apply_rule(policy_inputs(spark, sf_dir), p)
        )
    )


@query("j16_release_rule", sql(f"select {_COLUMNS} from violated where policy_id = 'PAC-RELEASE-001'"))
def release_rule(spark, sf_dir):
    violations = policy.violations_table(_evaluated(spark, sf_dir))
    return violations.where(F.col("policy_id") == "PAC-RELEASE-001")


@query(
    "j17_ordered_violations",
    sql("""select run_key, stage, policy_id, reason, details, row_number() over (partition by event_id
      order by policy_id, reason, details) position from violated"""),
)
def ordered_violations(spark, sf_dir):
    evaluated = _evaluated(spark, sf_dir)
    return evaluated.select(
        F.col("experiment.run_key").alias("run_key"),
        F.col("evaluation_stage").alias("stage"),
        F.posexplode_outer("violations").alias("p", "v"),
    ).where(F.col("v").isNotNull()).select(
        "run_key", "stage", "v.policy_id", "v.reason", "v.details",
        (F.col("p") + 1).cast("bigint").alias("position"),
    )


@query(
    "j18_policy_outcomes",
    sql("""select e.run_key, e.stage, n.policy_id, n.category, c.policy_id is not null applicable,
      case when c.policy_id is null and v.n is not null then 'OUT_OF_STAGE'
        when c.policy_id is null then 'NOT_APPLICABLE' when v.n is not null then 'DENY' else 'PASS' end
        outcome,
      coalesce(v.n, 0) violation_count, coalesce(v.reasons, '') reasons
    from ev e cross join policy_names n
    left join policy_catalog c on c.policy_id = n.policy_id and c.stage = e.stage
    left join (select event_id, policy_id, count(*) n,
        string_agg(distinct reason, '; ' order by reason) reasons from violated group by 1, 2) v
      on v.event_id = e.event_id and v.policy_id = n.policy_id"""),
)
def policy_outcomes(spark, sf_dir):
    return policy.policy_outcomes(_evaluated(spark, sf_dir))


@query(
    "j19_decisions",
    sql("""select run_key, scenario_id, evaluation_stage, decision, allow, violation_count,
      triggered_policy_ids, applicable_policy_count, denied_policy_count, promotion_requested,
      promotion_blocked from decided"""),
)
def decisions(spark, sf_dir):
    made = policy.decisions(_evaluated(spark, sf_dir))
    return made.withColumn(
        "triggered_policy_ids", F.array_join("triggered_policy_ids", ",")
    ).drop("violations", "recorded_at", "condition")
