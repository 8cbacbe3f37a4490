"""Quoted CSV with line breaks inside fields, read by many tasks per file.

A line feed ends a record only outside quotes, which depends on everything before it in the file;
Spark's multi-line reader therefore gives a whole file to one task. Here a file is read in its
splits, as lines. First the parity of the quotes of every split is counted; the parities of the
earlier splits of a file, one small row each, tell whether a split begins inside quotes. Then every
split cuts its lines at line feeds of even parity by itself, and only a record that runs over the
end of a split is put together from its parts. An escaped quote is two quotes, so it changes
no parity. Files whose quotes do not balance are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.session import written

WHOLE, TAIL, THROUGH, HEAD = "whole", "tail", "through", "head"
_PARTS = "_file string, _split bigint, _record bigint, _kind string, text string"
_SCHEMA = pa.schema(
    [
        ("_file", pa.string()),
        ("_split", pa.int64()),
        ("_record", pa.int64()),
        ("_kind", pa.string()),
        ("text", pa.string()),
    ]
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the offset of their split in it, and their place in the scan."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per split with lines: whether it begins inside quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parities = written(
        _lines(spark, path)
        .groupBy("_file", "_split")
        .agg((F.sum(quotes) % 2).alias("_odd")),
        "parities",
    )
    broken = parities.groupBy("_file").agg(F.sum("_odd").alias("n")).where("n % 2 = 1")
    if found := broken.take(3):
        raise ValueError(f"quotes do not balance in {[r['_file'] for r in found]}")
    earlier = (
        Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2 == 1
    return written(parities.select("_file", "_split", inside.alias("_inside")), "splits")


class _Split:
    """The records of one split, line by line."""

    def __init__(self, file: str, split: int, inside: bool):
        self.file, self.split, self.inside = file, split, inside
        self.continues, self.record, self.held = inside, 0, []

    def take(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        """Lines in order; gives the parts that end among them."""
        odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1
        state = (np.cumsum(odd) + self.inside) & 1
        ends = np.flatnonzero(state == 0)
        self.inside = bool(state[-1])
        if not len(ends):
            self.held += values.to_pylist()
            return
        begins = np.concatenate([[0], ends[:-1] + 1])
        single = np.all(begins == ends) and not self.held
        if single:
            texts = values.take(pa.array(ends))
        else:
            lines = values.to_pylist()
            parts = ["\n".join(lines[a : b + 1]) for a, b in zip(begins.tolist(), ends.tolist())]
            parts[0] = "\n".join([*self.held, parts[0]])
            texts = pa.array(parts, pa.string())
        self.held = values.slice(int(ends[-1]) + 1).to_pylist()
        kinds = [WHOLE] * len(texts)
        if self.continues:
            kinds[0], self.continues = HEAD, False
        yield self._rows(kinds, texts)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            kind = THROUGH if self.continues else TAIL
            yield self._rows([kind], pa.array(["\n".join(self.held)], pa.string()))

    def _rows(self, kinds: list[str], texts: pa.Array) -> pa.RecordBatch:
        n, first = len(texts), self.record
        self.record += n
        columns = [
            pa.array([self.file] * n, pa.string()),
            pa.array([self.split] * n, pa.int64()),
            pa.array(range(first, first + n), pa.int64()),
            pa.array(kinds, pa.string()),
            texts.cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: _Split | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.column("_inside").null_count:
            raise RuntimeError("the splits of the files changed between two reads: read them again")
        files, splits = batch.column("_file"), batch.column("_split")
        changed = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(splits[1:], splits[:-1]))
        cuts = np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            name = files[a].as_py(), splits[a].as_py()
            if current is None or (current.file, current.split) != name:
                if current is not None:
                    yield from current.end()
                current = _Split(*name, batch.column("_inside")[a].as_py())
            yield from current.take(batch.column("value").slice(a, b - a))
    if current is not None:
        yield from current.end()


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as text, without the line feed that ends it: (header, text).

    ``header`` is true for the first record of a file. Empty records are left out, as the quoted
    reader does.
    """
    states, lines = split_states(spark, path), _lines(spark, path)
    met = lines.join(states, ["_file", "_split"], "left")
    ordered = met.sortWithinPartitions("_file", "_split", "_line")
    cut = ordered.select("_file", "_split", "_inside", "value").mapInArrow(_cut, _PARTS)
    # What runs over the end of a split is rare, but the records are needed twice: once whole,
    # once for their parts.
    parts = written(cut, "records")
    whole = parts.where(F.col("_kind") == WHOLE).select("_split", "_record", "text")
    return whole.unionByName(_put_together(parts.where(F.col("_kind") != WHOLE))).select(
        ((F.col("_split") == 0) & (F.col("_record") == 0)).alias("header"),
        F.regexp_replace("text", "\r$", "").alias("text"),
    ).where(F.col("text") != "")


def _put_together(parts: DataFrame) -> DataFrame:
    """Records from their tail in one split, the splits they run through, and their head."""
    upto = Window.partitionBy("_file").orderBy("_split", "_record")
    number = F.count_if(F.col("_kind") == TAIL).over(upto)
    numbered = parts.withColumn("_number", number)
    lines = F.sort_array(F.collect_list(F.struct("_split", "_record", "text")))
    joined = numbered.groupBy("_file", "_number").agg(lines.alias("_lines"))
    first = F.col("_lines")[0]
    return joined.select(
        first["_split"].alias("_split"),
        first["_record"].alias("_record"),
        F.array_join(F.transform("_lines", lambda line: line["text"]), "\n").alias("text"),
    )
