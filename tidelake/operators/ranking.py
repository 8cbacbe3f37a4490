"""Row numbers, running totals, medians and modes that survive a hot group.

A window or a ``median`` puts one group into one task. Here rows are dealt out once, in sorted
ranges of the group and ordering columns, and each range is read in order. Of the groups in a range
only the first can have begun in an earlier one, and only the last can go on in a later one, so
what ranges need to know of each other is one row per range: its borders. Groups of every size go
the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelake.functions.scalar import rounded_ratio
from tidelake.session import written


def _in_ranges(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """The rows in sorted ranges of ``group`` and ``order``, each with the number of its range."""
    marks = {f"_order{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    by = [*group, *marks]
    ranges = df.withColumns(marks).repartitionByRange(*by).sortWithinPartitions(*by)
    return ranges.drop(*marks).withColumn("_range", F.spark_partition_id())


def _differs(a: pa.Array, b: pa.Array) -> pa.Array:
    """Where two arrays differ; NULL equals NULL, and NaN equals NaN."""
    same = pc.fill_null(pc.equal(a, b), False)
    same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(a.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.invert(same)


class _Groups:
    """Where groups begin in a run of batches; the first group of all begins nowhere."""

    def __init__(self, group: list[str]):
        self.group = group
        self.last: dict[str, pa.Array] = {}

    def starts(self, batch: pa.RecordBatch) -> np.ndarray:
        changed = np.zeros(batch.num_rows, dtype=bool)
        for name in self.group:
            values = batch.column(name)
            before = self.last.get(name, values.slice(0, 1))
            shifted = pa.concat_arrays([before, values.slice(0, len(values) - 1)])
            changed |= _differs(values, shifted).to_numpy(zero_copy_only=False)
            self.last[name] = values.slice(len(values) - 1)
        return np.flatnonzero(changed)


def _running(group: list[str], schema: pa.Schema):
    """Running totals inside the groups of a range, and which rows its borders are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, total, first, row, held = _Groups(group), 0, True, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            starts = groups.starts(batch)
            weight = batch.column("_weight").to_numpy(zero_copy_only=False)
            upto = np.cumsum(weight)
            number = np.zeros(batch.num_rows, dtype=np.int64)
            number[starts] = 1
            number = np.cumsum(number)
            before = np.concatenate([[-total], upto[starts] - weight[starts]])
            local = upto - before[number]
            place = np.arange(row, row + batch.num_rows)
            added = {
                "_local": pa.array(local, pa.int64()),
                "_first": pa.array((number == 0) & first),
                "_place": pa.array(place, pa.int64()),
                "_edge": pa.array(place == 0),
            }
            columns = [added.get(n) if n in added else batch.column(n) for n in schema.names]
            held = pa.RecordBatch.from_arrays(columns, schema=schema)
            total, first, row = int(local[-1]), first and not len(starts), row + batch.num_rows
        if held is not None:
            edge = held.column("_edge").to_numpy(zero_copy_only=False).copy()
            edge[-1] = True
            at = schema.names.index("_edge")
            yield held.set_column(at, schema.field(at), pa.array(edge))

    return run


def _with(schema: T.StructType, added: str) -> T.StructType:
    """The schema and more columns; any of them may be NULL."""
    fields = [*schema.fields, *T.StructType.fromDDL(added).fields]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields])


def running_total(
    df: DataFrame, group: list[str], order: list[str | Column], weight: Column, name: str
) -> DataFrame:
    """Inclusive running total of the whole number ``weight`` inside each group.

    The rows are shuffled and written once. The total that a range's first group brings along is
    the sum of the last totals of the earlier ranges that end in the same group.
    """
    columns, keys = df.columns, group
    if not group:
        keys, df = ["_all"], df.withColumn("_all", F.lit(0))
    ranges = _in_ranges(df.withColumn("_weight", weight.cast("bigint")), keys, order)
    schema = _with(ranges.schema, "_local bigint, _first boolean, _place bigint, _edge boolean")
    run = _running(keys, to_arrow_schema(schema))
    ranged = written(ranges.mapInArrow(run, schema), "ranges")
    held, last = F.struct(*keys), F.struct(*keys, "_local")
    borders = (
        ranged.where("_edge")
        .groupBy("_range")
        .agg(F.min_by(held, "_place").alias("head"), F.max_by(last, "_place").alias("tail"))
    )
    heads = borders.select("_range", F.col("head").alias("_head"))
    tails = borders.select(
        F.col("_range").alias("_earlier"),
        F.struct(*[F.col("tail")[k].alias(k) for k in keys]).alias("_tail"),
        F.col("tail._local").alias("_brought"),
    )
    same = F.col("_head").eqNullSafe(F.col("_tail")) & (F.col("_earlier") < F.col("_range"))
    brought = heads.join(tails, same).groupBy("_range").agg(F.sum("_brought").alias("_brought"))
    # One row per range: as many as shuffle partitions, whatever the data.
    joined = ranged.join(F.broadcast(brought), "_range", "left")
    before = F.when(F.col("_first"), F.coalesce("_brought", F.lit(0))).otherwise(F.lit(0))
    return joined.select(*columns, (before + F.col("_local")).alias(name))


def occurrence_number(
    df: DataFrame, group: list[str], order: list[str | Column], name: str
) -> DataFrame:
    """1-based position of each row inside its group."""
    return running_total(df, group, order, F.lit(1), name)


def _nearest(batch: pa.RecordBatch, starts: np.ndarray, cuts: list[float]):
    """Rows in the order of their values, cut into whole groups: totals, and for each quantile
    the values below and above it."""
    value = batch.column("_value").to_numpy(zero_copy_only=False)
    upto = np.cumsum(batch.column("_n").to_numpy(zero_copy_only=False))
    ends = upto[np.concatenate([starts[1:], [batch.num_rows]]) - 1]
    before = np.concatenate([[0], ends[:-1]])
    total = ends - before
    sides = []
    for side in (np.floor, np.ceil):
        places = [before + side((total - 1) * q).astype(np.int64) for q in cuts]
        rows = [np.minimum(np.searchsorted(upto, p, side="right"), len(upto) - 1) for p in places]
        sides.append(np.stack([value[r] for r in rows], axis=1))
    return total, *sides


def _quantiles(keys: list[str], cuts: list[float], schema: pa.Schema):
    """Groups that lie whole in a range, with the values around their quantiles; the rows of its
    first and of its last group, which may lie in other ranges too."""

    def rows_of(batch: pa.RecordBatch, **added) -> pa.RecordBatch:
        columns = [
            added[n] if n in added
            else batch.column(n) if n in batch.schema.names
            else pa.nulls(batch.num_rows, schema.field(n).type)
            for n in schema.names
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def opened(batch: pa.RecordBatch, total: int) -> pa.RecordBatch:
        upto = np.cumsum(batch.column("_n").to_numpy(zero_copy_only=False)) + total
        return rows_of(batch, _upto=pa.array(upto, pa.int64()))

    def closed(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        total, low, high = _nearest(batch, starts, cuts)
        lists = {
            n: pa.array([x if t else None for x, t in zip(v.tolist(), total.tolist())], pa.list_(pa.float64()))
            for n, v in (("_low", low), ("_high", high))
        }
        some = batch.take(pa.array(starts)).select([n for n in keys])
        return rows_of(some, _total=pa.array(total, pa.int64()), **lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, first, total, pending = _Groups(keys), True, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = groups.starts(batch)
            begin = int(starts[0]) if len(starts) else batch.num_rows
            if begin and first:
                head = batch.slice(0, begin)
                yield opened(head, total)
                total += pc.sum(head.column("_n")).as_py()
            elif begin:
                pending.append(batch.slice(0, begin))
            if not len(starts):
                continue
            if pending:
                yield closed(pa.concat_batches(pending), np.zeros(1, dtype=np.int64))
            if len(starts) > 1:
                yield closed(batch.slice(begin, int(starts[-1]) - begin), starts[:-1] - begin)
            first, pending = False, [batch.slice(int(starts[-1]))]
        if pending:
            yield opened(pa.concat_batches(pending), 0)

    return run


def exact_quantiles(
    df: DataFrame, group: list[str], cuts: dict[str, tuple[str, float]]
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group; NULLs ignored, empty gives NULL.

    ``cuts`` maps an output name to (column, quantile). The values of all columns are counted in
    one long table, which is read in sorted ranges: a group that lies whole in a range is done
    there, and only the rows of the groups at the borders are put together afterwards. Between two
    neighbouring values low and high a share s gives low + (high - low) * s.
    """
    columns = sorted({column for column, _ in cuts.values()})
    shares = sorted({q for _, q in cuts.values()})
    cells = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]
    keys = [*group, "_column"]
    # A NULL value keeps its group; it counts as no row.
    counts = (
        df.select(*group, F.inline(F.array(*cells)))
        .groupBy(*keys, "_value")
        .agg(F.count("_value").alias("_n"))
    )
    ranges = _in_ranges(counts, keys, ["_value"])
    schema = _with(
        ranges.schema, "_upto bigint, _total bigint, _low array<double>, _high array<double>"
    )
    ranged = written(
        ranges.mapInArrow(_quantiles(keys, shares, to_arrow_schema(schema)), schema), "ranges"
    )
    done = ranged.where(F.col("_upto").isNull()).select(*keys, "_total", "_low", "_high")
    found = done.unionByName(_at_borders(ranged.where(F.col("_upto").isNotNull()), keys, shares))
    ends = []
    for name, (column, q) in cuts.items():
        place = (F.col("_total") - 1) * F.lit(q)
        low, high = F.col("_low")[shares.index(q)], F.col("_high")[shares.index(q)]
        value = low + (high - low) * (place - F.floor(place))
        ends.append(F.max(F.when(F.col("_column") == column, value)).alias(name))
    return found.groupBy(*group).agg(*ends)


def _at_borders(rows: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """Totals and the values around the quantiles of groups that may lie in several ranges."""
    parts = rows.groupBy(*keys, "_range").agg(F.sum("_n").alias("_part"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most two rows per range: twice as many as shuffle partitions, whatever the data.
    names = {k: f"_key{i}" for i, k in enumerate([*keys, "_range"])}
    borders = parts.select(
        *[F.col(k).alias(name) for k, name in names.items()],
        F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_part").over(whole).alias("_all"),
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(name)) for k, name in names.items()])
    met = rows.join(F.broadcast(borders), same)
    upto = F.col("_before") + F.col("_upto")
    place = [(F.col("_all") - 1) * F.lit(q) for q in shares]

    def around(side) -> Column:
        hits = [(side(p) + 1).between(upto - F.col("_n") + 1, upto) for p in place]
        values = [F.max(F.when((F.col("_n") > 0) & hit, F.col("_value"))) for hit in hits]
        return F.array(*values)

    return met.groupBy(*keys).agg(
        F.max("_all").alias("_total"), around(F.floor).alias("_low"), around(F.ceil).alias("_high")
    )


def representative_mode(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Most frequent non-NULL value per group; a tie goes to the smallest value.

    Both steps combine on the map side, so a hot group arrives as one row per value and
    then as one row per task.
    """
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(*group, column)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min(F.struct((-F.col("_n")).alias("rank"), F.col(column).alias("value")))
    return counts.groupBy(*group).agg(best["value"].alias(column))


def with_share_of_total(df: DataFrame, measure: str, name: str, places: int = 2) -> DataFrame:
    """Percentage of the grand total.

    The grouped rows are written once, so the total is a sum over them and not a second
    run of the plan that made them; read as a scalar, it needs no one-task window.
    """
    grouped = written(df, "grouped")
    total = grouped.agg(F.sum(measure)).scalar()
    return grouped.withColumn(name, rounded_ratio(F.col(measure) * 100, total, places))
