"""Publication by pointer, pruned appends, declared tests, suite counts and edges."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidelake.operators import acceptance, joins, profile, publication, remediation
from tidelake.operators import quality as Q


@pytest.fixture
def contacts(spark):
    rows = [(i, f"write to u{i}@mail.example or +353 86 123 45{i:02d} {i}", "x") for i in range(10)]
    return spark.createDataFrame(rows, "id int, note string, secret string")


def outcome(df):
    return df.first().asDict()


def test_clean_candidate_is_published_and_readers_follow(spark, tmp_path, contacts):
    root, args = str(tmp_path), (["note"], ["secret"])
    with pytest.raises(FileNotFoundError):
        publication.read_published(spark, root, "c")
    clean = remediation.redact(contacts, ["secret"], ["note"])
    first = outcome(publication.republish(contacts, clean, root, "c", *args))
    assert (first["outcome"], first["pointer"], first["leftovers"]) == ("PUBLISHED", 1, 0)
    assert publication.read_published(spark, root, "c").columns == ["id", "note"]
    again = clean.withColumn("note", F.lit("nothing"))
    second = outcome(publication.republish(contacts, again, root, "c", *args))
    assert (second["outcome"], second["pointer"]) == ("PUBLISHED", 2)
    assert {r["note"] for r in publication.read_published(spark, root, "c").collect()} == {"nothing"}


def test_dirty_candidates_are_not_published(spark, tmp_path, contacts):
    root, args = str(tmp_path), (["note"], ["secret"])
    clean = remediation.redact(contacts, ["secret"], ["note"])
    candidates = {
        "unmasked": contacts.drop("secret"),
        "forbidden": remediation.redact(contacts, [], ["note"]),
        "changed": clean.withColumn("id", F.col("id") + 1),
        "lost rows": clean.where("id > 3"),
        "more columns": clean.withColumn("extra", F.lit(1)),
    }
    for name, candidate in candidates.items():
        found = outcome(publication.republish(contacts, candidate, root, "c", *args))
        assert (found["outcome"], found["pointer"]) == ("REJECTED", 0), name
    assert publication.current(spark, root, "c") == publication.Pointer()


def test_of_two_writers_one_wins(spark, tmp_path, contacts):
    root, args = str(tmp_path), (["note"], ["secret"])
    clean = remediation.redact(contacts, ["secret"], ["note"])
    seen = publication.current(spark, root, "c")
    first = outcome(publication.republish(contacts, clean, root, "c", *args, seen=seen))
    late = clean.withColumn("note", F.lit("late"))
    second = outcome(publication.republish(contacts, late, root, "c", *args, seen=seen))
    assert (first["outcome"], second["outcome"]) == ("PUBLISHED", "BEATEN")
    assert second["pointer"] == 1 and second["published_sha256"] == first["published_sha256"]
    assert publication.move_pointer(spark, root, "c", seen, "elsewhere", "0") is None


def events(spark, ids, day):
    stamp = datetime.datetime(2024, 1, day, 12)
    schema = "quarantine_event_id string, detected_at timestamp, note string"
    return spark.createDataFrame([(f"e{day}-{i}", stamp, "n") for i in ids], schema)


def test_replays_add_nothing_and_read_their_days_only(spark, tmp_path):
    path = str(tmp_path / "events")
    for day in range(1, 6):
        remediation.append_events(events(spark, range(3), day), path)
    assert remediation.append_events(events(spark, range(5), 3), path).count() == 17
    assert remediation.append_events(events(spark, range(5), 3), path).count() == 17
    new = events(spark, range(2), 4).withColumn("detected_date", F.to_date("detected_at"))
    history = spark.read.schema(new.schema).parquet(path)
    known = remediation.known_events(new, history)
    assert known.count() == 3
    files = {r[0] for r in known.select(F.input_file_name()).distinct().collect()}
    assert files and all("detected_date=2024-01-04" in f for f in files)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(detected_date" in plan or "PartitionFilters: [detected_date" in plan


def test_declared_tests_count_values_not_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, "a"), (3, None), (1, "b")], "x int, y string")
    found = Q.declared_tests({"d": df, "e": df.limit(0)}, {"d": {"x": True, "y": True}, "e": {"x": True}})
    assert {(r["dataset"], r["check_name"]): r["observed_value"] for r in found.collect()} == {
        ("d", "x_not_null"): "0", ("d", "x_unique"): "1", ("d", "y_not_null"): "2",
        ("d", "y_unique"): "1", ("e", "x_not_null"): "0", ("e", "x_unique"): "0",
    }


def test_a_suite_with_too_few_checks_is_refused(spark):
    rows = [("a", "PASS"), ("a", "PASS"), ("b", "PASS")]
    df = spark.createDataFrame(rows, "dataset string, status string")
    found = acceptance.accept_suites(
        {"full": df, "short": df.limit(1), "bad": df.withColumn("status", F.lit("FAIL"))},
        {"full": 3, "short": 3, "bad": 3, "none": 1},
        {"full": 2, "short": 2, "bad": 2, "none": 1},
    )
    got = {r["suite"]: (r["suite_complete"], r["status"]) for r in found.collect()}
    assert got == {"full": (True, "PASS"), "short": (False, "FAIL"), "bad": (True, "FAIL"), "none": (False, "FAIL")}


def test_edges_in_one_grouping(spark):
    child = spark.createDataFrame([(1,), (1,), (9,), (None,), (9,)], "k int")
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "p int")
    edges = [joins.Edge("c/fk", "c", "k", "d", "p"), joins.Edge("d/back", "d", "p", "c", "k")]
    found = joins.edge_keys({"c": child, "d": parent}, edges)
    got = {(r["dataset"], r["check_name"]): r["observed_value"] for r in Q.orphan_results(found, edges).collect()}
    assert got == {("c", "fk"): "3", ("d", "back"): "3"}
    share = Q.covered(joins.edge_keys({"c": child, "d": parent}, edges[:1]), edges[0]).first()
    assert share["observed_value"] == "100.0"


def test_unique_rows_and_keys_of_several_datasets(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (None, None)], "k int, v string")
    found = Q.unique_rows_and_keys({"d": (df, ["k"]), "e": (df.limit(0), ["k"])})
    assert {(r["dataset"], r["check_name"]): r["observed_value"] for r in found.collect()} == {
        ("d", "no_full_duplicate_rows"): "1", ("d", "primary_key_unique"): "3",
        ("e", "no_full_duplicate_rows"): "0", ("e", "primary_key_unique"): "0",
    }


def test_measured_and_observed_checks_agree(spark):
    df = spark.range(10).selectExpr("id", "id - 3 v", "cast(id as decimal(18,4)) d")
    checks = [Q.not_empty(), *Q.non_negative(["v"]), Q.sums_to_hundred("s", "d")]
    measured = Q.known_results(spark, [("d", c, Q.measure(df, checks)[c.name]) for c in checks])
    assert sorted(map(tuple, measured.collect())) == sorted(map(tuple, Q.run_checks(df, "d", checks).collect()))


def test_profiles_send_no_free_text(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", -0.0), (None, 0.0), ("c", None), ("d", 2.5)], "s string, x double")
    found = profile.column_profiles({"t": df, "u": df.limit(0)})
    rows = {(r["dataset"], r["column_name"]): r for r in found.collect()}
    assert rows["t", "s"]["sample_values"] == "a | b | c" and rows["t", "s"]["unique_count"] == 4
    assert rows["t", "x"]["sample_values"] == "0.0 | 1.0 | 2.5" and rows["t", "x"]["unique_count"] == 3
    assert (rows["t", "x"]["null_count"], rows["t", "x"]["null_percentage"]) == (1, 20.0)
    assert (rows["u", "s"]["row_count"], rows["u", "s"]["sample_values"]) == (0, "")
