"""Ledger of the cells that typing could not keep.

Typing turns text that it cannot read into NULL, and sums leave out amounts beyond the money type.
Both are right for one cell and wrong in silence, so every such cell becomes a ledger row: its
dataset, record, column, raw text and the reason. Checks read the ledger, not the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions import scalar as S
from tidelake.session import small_table

UNREADABLE, DOES_NOT_FIT, BEYOND_MONEY = "unreadable", "does_not_fit", "beyond_money"

# How a cell of each kind can be lost.
REASONS = {
    "string": (),
    "timestamp": (UNREADABLE,),
    "consent": (UNREADABLE,),
    "bigint": (UNREADABLE, DOES_NOT_FIT),
    "double": (UNREADABLE, DOES_NOT_FIT),
    "money": (UNREADABLE, DOES_NOT_FIT, BEYOND_MONEY),
}

LEDGER_SCHEMA = (
    "dataset string, record_key string, column_name string, raw_text string, reason string"
)


def rejection(value: Column | str, kind: str) -> Column:
    """Why a raw cell is lost as ``kind``; NULL for a cell that is kept or blank."""
    text = S.clean_string(value)
    kept = S.READERS[kind](value)
    if UNREADABLE not in REASONS[kind]:
        return F.lit(None).cast("string")
    if DOES_NOT_FIT not in REASONS[kind]:
        return F.when(text.isNotNull() & kept.isNull(), UNREADABLE)
    found = (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(~text.rlike(S.DECIMAL), UNREADABLE)
        .when(kept.isNull(), DOES_NOT_FIT)
    )
    if BEYOND_MONEY in REASONS[kind]:
        found = found.when(S.money(kept).isNull(), BEYOND_MONEY)
    return found


def rejected_cells(
    raw: DataFrame, dataset: str, key: list[str], kinds: dict[str, str]
) -> DataFrame:
    """One row per lost cell of the raw records, repeated records included; no shuffle."""
    typed = {column: kind for column, kind in kinds.items() if REASONS[kind]}
    read = S.typed_cells(raw, typed, tuple(dict.fromkeys([*key, *typed])))
    cells = [
        F.struct(
            F.lit(column).alias("column_name"),
            F.col(column).cast("string").alias("raw_text"),
            _read_rejection(str(i), kind).alias("reason"),
        )
        for i, (column, kind) in enumerate(typed.items())
    ]
    # Cells are filtered after they are made: a condition on the records is pushed below the steps
    # of the reading, which would then be worked out once for every mention.
    lost = read.select(*key, F.inline(F.array(*cells))).where(F.col("reason").isNotNull())
    parts = [F.coalesce(S.clean_string(k), F.lit("")) for k in key]
    return lost.select(
        F.lit(dataset).alias("dataset"),
        F.concat_ws("|", *parts).alias("record_key"),
        "column_name",
        "raw_text",
        "reason",
    )


def _read_rejection(i: str, kind: str) -> Column:
    """``rejection`` of a cell that ``typed_cells`` has read."""
    text, kept = F.col(f"_text{i}"), F.col(f"_cell{i}")
    if DOES_NOT_FIT not in REASONS[kind]:
        return F.when(text.isNotNull() & kept.isNull(), UNREADABLE)
    found = F.when(~F.col(f"_plain{i}"), UNREADABLE).when(
        text.isNotNull() & kept.isNull(), DOES_NOT_FIT
    )
    if BEYOND_MONEY in REASONS[kind]:
        # Every amount below a tenth of the type's bound fits: it need not be cast.
        found = found.when((F.abs(kept) >= F.lit(1e15)) & S.money(kept).isNull(), BEYOND_MONEY)
    return found


def ledger_checks(ledger: DataFrame, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """One check per dataset, column and possible reason: the number of lost cells, wanted 0.

    An amount beyond the money type is missing in every sum, which is critical; a cell that was
    never readable is a warning.
    """
    declared = [
        (dataset, column, reason)
        for dataset, columns in kinds.items()
        for column, kind in columns.items()
        for reason in REASONS[kind]
    ]
    wanted = small_table(
        ledger.sparkSession, declared, "dataset string, column_name string, reason string"
    )
    counts = ledger.groupBy("dataset", "column_name", "reason").agg(
        F.count(F.lit(1)).alias("cells")
    )
    cells = F.coalesce("cells", F.lit(0))
    return wanted.join(counts, ["dataset", "column_name", "reason"], "left").select(
        "dataset",
        F.concat_ws("_", "column_name", "reason").alias("check_name"),
        F.when(cells == 0, "PASS").otherwise("FAIL").alias("status"),
        F.when(F.col("reason") == BEYOND_MONEY, "critical").otherwise("warning").alias("severity"),
        cells.cast("string").alias("observed_value"),
        F.lit("0").alias("expected_value"),
        F.lit("raw cells without a typed value").alias("details"),
    )
