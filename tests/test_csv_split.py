"""Quoted CSV read in splits: the same records as the quoted reader, wherever the splits fall."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidelake.sources import csv_split, readers
from tidelake.sources.schemas import RAW_COLUMNS

COLUMNS = RAW_COLUMNS["sellers"]
PIECES = ["a", "é", " ", ",", '"', '""', "\n", "\r\n", "\r", "\n\n", "x" * 30, "漢", "'", ";", "1"]


def text_file(path, rows, ending="\n", header=COLUMNS):
    out = io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=ending)
    writer.writerow(header)
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode("utf-8"))
    return str(path)


def quoted(spark, path):
    """Spark's own reader of whole files."""
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


@pytest.fixture
def splits(spark):
    """Reads files in splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def of(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield of
    for n, value in before.items():
        spark.conf.set(n, value)


@pytest.mark.parametrize("size,seed", [(150, 2), (700, 3)])
def test_same_records_whatever_the_splits(spark, tmp_path, splits, size, seed):
    draw = random.Random(seed)
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(3):
        rows = [
            [f"{i}-{k}", *("".join(draw.choices(PIECES, k=draw.randint(0, 9))) for _ in COLUMNS[1:])]
            for k in range(40)
        ]
        text_file(folder / f"{i}.csv", rows, "\n")
    want = rows_of(quoted(spark, str(folder)))
    assert len(want) == 120
    splits(size)
    assert csv_split.split_states(spark, str(folder)).count() > 3
    assert rows_of(readers.read_raw_csv(spark, str(folder), "sellers")) == want


def test_a_record_longer_than_many_splits(spark, tmp_path, splits):
    long = "line\n" * 400 + 'with "quotes" and, commas' * 10
    path = text_file(tmp_path / "s.csv", [["1", long, "c", "X"], ["2", "b", "c\nd", "Y"], ["3", "", long, "Z"]])
    splits(200)
    found = {r["seller_id"]: r for r in readers.read_raw_csv(spark, path, "sellers").collect()}
    assert found["1"][1] == long and found["2"][2] == "c\nd" and found["3"][2] == long
    assert len(found) == 3
    splitted = csv_split.split_states(spark, path)
    assert splitted.where("_inside").count() > 10


def test_windows_line_ends_and_plain_fields(spark, tmp_path, splits):
    text = ",".join(COLUMNS) + '\r\n1,2,a b,X\r\n\r\n2,"3","c\r\nd",\r\n3,,,\r\n'
    (tmp_path / "w.csv").write_bytes(text.encode())
    splits(16)
    assert rows_of(readers.read_raw_csv(spark, str(tmp_path / "w.csv"), "sellers")) == [
        ("1", "2", "a b", "X"), ("2", "3", "c\r\nd", None), ("3", None, None, None),
    ]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, splits):
    path = text_file(tmp_path / "s.csv", [[str(i), "a\nb", "c", "X"] for i in range(4000)])
    splits(8192)
    parts = csv_split.records(spark, path).select(F.spark_partition_id()).distinct().count()
    assert parts > 4
    assert readers.read_raw_csv(spark, path, "sellers").count() == 4000


def test_every_header_is_checked(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    text_file(folder / "good.csv", [["1", "2", "3", "4"]])
    assert readers.read_raw_csv(spark, str(folder), "sellers").count() == 1
    for wrong in (COLUMNS[:3], [*COLUMNS, "more"], COLUMNS[::-1], ["seller_id"] * 4):
        text_file(folder / "wrong.csv", [["1", "2", "3", "4"]], header=wrong)
        with pytest.raises(ValueError, match="header"):
            readers.read_raw_csv(spark, str(folder), "sellers")


def test_open_quotes_are_refused(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text(",".join(COLUMNS) + '\n1,2,"never closed,X\n')
    with pytest.raises(ValueError, match="balance"):
        readers.read_raw_csv(spark, str(path), "sellers")


def test_file_with_a_header_only(spark, tmp_path):
    path = text_file(tmp_path / "none.csv", [])
    assert readers.read_raw_csv(spark, path, "sellers").collect() == []
