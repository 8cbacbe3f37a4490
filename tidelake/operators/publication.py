"""Publication of a dataset by a pointer that only one writer can move.

A dataset's readers follow its pointer: the entry with the highest number in its pointer folder,
which names the path and the content digest of what is published. A new candidate is written
under a path of its own, where no reader looks; it is checked there, and published by creating the
entry with the next number. The store creates a file only if there is none, so of two writers that
saw the same pointer one wins, and the other one's candidate stays unpublished.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.contracts import forbidden_name_parts
from tidelake.operators.remediation import mask_pii
from tidelake.session import small_table
from tidelake.sources.sinks import content_hash

PUBLISHED, REJECTED, BEATEN = "PUBLISHED", "REJECTED", "BEATEN"
POINTER_SCHEMA = "number bigint, path string, content_sha256 string"


@dataclass(frozen=True)
class Pointer:
    """What is published: number 0 stands for nothing yet."""

    number: int = 0
    path: str | None = None
    content_sha256: str | None = None


def _pointers(root: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/pointers/{dataset}"


def current(spark: SparkSession, root: str, dataset: str) -> Pointer:
    """The pointer as it stands now."""
    try:
        entries = spark.read.schema(POINTER_SCHEMA).json(_pointers(root, dataset))
        row = entries.orderBy(F.desc("number")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return Pointer(*row) if row is not None else Pointer()


def read_published(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The published content of a dataset."""
    pointer = current(spark, root, dataset)
    if pointer.path is None:
        raise FileNotFoundError(f"{dataset} is not published")
    return spark.read.parquet(pointer.path)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this content; False if there is one already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    try:
        stream = files.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return True


def move_pointer(
    spark: SparkSession, root: str, dataset: str, seen: Pointer, path: str, digest: str
) -> Pointer | None:
    """Publish ``path`` if the pointer is still the one that was seen; None if another won."""
    new = Pointer(seen.number + 1, path, digest)
    entry = json.dumps({"number": new.number, "path": path, "content_sha256": digest})
    name = f"{_pointers(root, dataset)}/{new.number:012d}.json"
    return new if _create(spark, name, entry) else None


def check_candidate(
    candidate: DataFrame, source: DataFrame, masked: list[str], dropped: list[str]
) -> dict:
    """What a redacted candidate still gives away, and whether it changed anything else."""
    texts = [c for c in masked if c in candidate.columns]
    leaks = [F.coalesce(F.col(c) != mask_pii(c), F.lit(False)) for c in texts]
    found = candidate.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(reduce(or_, leaks, F.lit(False))).alias("leftovers"),
    ).first()
    kept = [c for c in source.columns if c not in masked and c not in dropped]
    same = set(candidate.columns) == {*kept, *texts} and (
        content_hash(candidate.select(*kept)).first() == content_hash(source.select(*kept)).first()
    )
    return {
        "row_count": found["rows"],
        "leftovers": found["leftovers"],
        "forbidden_columns": len([c for c in candidate.columns if c in dropped]),
        "others_unchanged": same,
    }


def republish(
    source: DataFrame,
    candidate: DataFrame,
    root: str,
    dataset: str,
    masked: list[str],
    dropped: list[str],
    seen: Pointer | None = None,
    public: bool = False,
) -> DataFrame:
    """Write a redacted candidate, check it, and publish it if it is clean and nobody was faster.

    ``seen`` is the pointer that the candidate was made from; by default the one of now. One row:
    the outcome, what the checks found and the number of the pointer that stands afterwards.
    """
    spark = source.sparkSession
    seen = seen or current(spark, root, dataset)
    path = f"{root.rstrip('/')}/candidates/{dataset}/{uuid.uuid4().hex}"
    candidate.write.mode("errorifexists").parquet(path)
    written = spark.read.schema(candidate.schema).parquet(path)
    found = check_candidate(written, source, masked, dropped)
    clean = not found["leftovers"] and not found["forbidden_columns"] and found["others_unchanged"]
    if public and forbidden_name_parts(candidate.columns):
        clean = False
    outcome = REJECTED
    if clean:
        digest = content_hash(written).first()["content_sha256"]
        moved = move_pointer(spark, root, dataset, seen, path, digest)
        outcome = PUBLISHED if moved else BEATEN
    after = current(spark, root, dataset)
    return small_table(
        spark,
        [(dataset, outcome, *found.values(), after.number, after.content_sha256)],
        "dataset string, outcome string, row_count bigint, leftovers bigint,"
        " forbidden_columns bigint, others_unchanged boolean, pointer bigint,"
        " published_sha256 string",
    )
