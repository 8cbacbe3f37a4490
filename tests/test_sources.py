"""Readers and writers: exact text, refusals, run-unique paths, snapshots, files."""

import pytest
from pyspark.errors import AnalysisException

from tidelake.sources import readers, sinks


def write(path, text):
    path.write_bytes(text.encode("utf-8"))
    return str(path)


HEADER = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"


def test_csv_with_bom_and_embedded_breaks(spark, tmp_path):
    path = write(tmp_path / "s.csv", "﻿" + HEADER + '1,007,"a\r\nb ""q""",X\n2,,c,\n')
    rows = readers.read_raw_csv(spark, path, "sellers").orderBy("seller_id").collect()
    assert tuple(rows[0]) == ("1", "007", 'a\r\nb "q"', "X")
    assert tuple(rows[1]) == ("2", None, "c", None)


def test_missing_csv_fails(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_raw_csv(spark, str(tmp_path / "none.csv"), "sellers")


def test_conversion_counts_breaks_and_keeps_text(spark, tmp_path):
    path = write(tmp_path / "s.csv", HEADER + '1,007,"a\nb",X\n2,8,c,\n')
    out = str(tmp_path / "out")
    report = readers.convert_csv_to_json_lines(spark, path, out, "sellers").first()
    assert report.asDict() == {
        "records": 2, "wrong_arity": 0, "with_nul": 0, "with_line_break": 1,
    }
    lines = sorted(r["value"] for r in spark.read.text(out).collect())
    assert lines[0] == (
        '{"seller_id":"1","seller_zip_code_prefix":"007","seller_city":"a\\nb","seller_state":"X"}'
    )
    assert '"seller_state":""' in lines[1]
    shape = readers.json_shape_report(spark, out, "sellers", 2).first()
    assert tuple(shape) == (2, 0, 0, 0)


@pytest.mark.parametrize(
    "text", [HEADER + "1,2,3\n", HEADER + "1,2,a\0b,X\n", "a,a,b,c\n1,2,3,4\n"]
)
def test_conversion_refuses_malformed_input(spark, tmp_path, text):
    path = write(tmp_path / "bad.csv", text)
    with pytest.raises(ValueError):
        readers.convert_csv_to_json_lines(spark, path, str(tmp_path / "out"), "sellers")


def test_json_shape_violations_are_counted(spark, tmp_path):
    good = '{"seller_id":"1","seller_zip_code_prefix":"2","seller_city":"c","seller_state":"S"}'
    order = '{"seller_zip_code_prefix":"2","seller_id":"1","seller_city":"c","seller_state":"S"}'
    typed = '{"seller_id":1,"seller_zip_code_prefix":"2","seller_city":"c","seller_state":"S"}'
    path = write(tmp_path / "rows.jsonl", "\n".join([good, order, typed, "{broken"]))
    report = readers.json_shape_report(spark, path, "sellers", 5).first()
    assert tuple(report) == (4, 2, 2, 1)


def test_write_dataset_never_overwrites(spark, tmp_path):
    df = spark.range(3).toDF("a")
    written = sinks.write_dataset(df, str(tmp_path), "silver", "numbers", "r1")
    assert written.count() == 3
    with pytest.raises(AnalysisException):
        sinks.write_dataset(df, str(tmp_path), "silver", "numbers", "r1")
    with pytest.raises(ValueError):
        sinks.write_dataset(df, str(tmp_path), "attic", "numbers", "r2")


def test_snapshot_is_published_once_and_last(spark, tmp_path):
    df = spark.range(3).toDF("a")
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, root, "s1", "numbers")
    manifest = sinks.publish_snapshot(spark, root, "s1", {"numbers": df})
    assert manifest.first()["row_count"] == 3
    assert sinks.read_snapshot(spark, root, "s1", "numbers").count() == 3
    with pytest.raises(FileExistsError):
        sinks.publish_snapshot(spark, root, "s1", {"numbers": df})


def test_fingerprint_sees_values_and_repeats_not_order(spark):
    rows = [(1, "a"), (2, "b"), (2, "b")]
    def digest(data, parts):
        df = spark.createDataFrame(data, "x int, y string").repartition(parts)
        return sinks.content_hash(df).first()["content_sha256"]
    assert digest(rows, 1) == digest(rows[::-1], 5)
    assert digest(rows, 1) != digest(rows[:2], 1)
    assert digest(rows, 1) != digest([(1, "a"), (2, "b"), (2, "c")], 1)


def test_fingerprint_sees_where_a_null_stands(spark):
    def digest(rows):
        df = spark.createDataFrame(rows, "x string, y string")
        return sinks.content_hash(df).first()["content_sha256"]

    assert digest([(None, "x")]) != digest([("x", None)])
    assert digest([("a", "a")] * 2) != digest([("b", "b")] * 2)


def test_table_integrity_names_every_fault(spark):
    schema = "dataset string, rows long, columns long, total string"
    found = spark.createDataFrame(
        [("a", 1, 1, "1"), ("b", 1, 1, "1"), ("c", 1, 1, "1"), ("d", 1, 1, "1"), ("e", 0, 1, None),
         ("new", 1, 1, "1")], schema)
    manifest = spark.createDataFrame(
        [("a", 1, 1, "1"), ("b", 2, 1, "1"), ("c", 1, 2, "1"), ("d", 1, 1, "2"), ("e", 0, 1, None),
         ("gone", 1, 1, "1")], schema)
    got = {r["dataset"]: r["status"] for r in sinks.table_integrity(found, manifest).collect()}
    assert got == {
        "a": "PASS", "b": "ROW_MISMATCH", "c": "COLUMN_MISMATCH", "d": "TOTAL_MISMATCH",
        "e": "PASS", "new": "UNEXPECTED", "gone": "MISSING",
    }


def test_run_results_document(spark, tmp_path):
    write(tmp_path / "r.json", '{"results": [\n{"unique_id": "test.a", "status": "fail",'
          ' "failures": 2},\n{"unique_id": "model.b", "status": "success"}]}')
    rows = readers.read_run_results(spark, str(tmp_path / "r.json"), multi_line=True)
    assert sorted(map(tuple, rows.collect()), key=repr) == [
        ("model.b", "success", None), ("test.a", "fail", 2),
    ]
