"""Token counts of documents, without their ids.

A text falls into pre-tokens that no piece spans: runs of space marks with the characters up to
the next mark or line feed, and line feeds. The pieces of each distinct pre-token are counted
once, by the sentencepiece library, met with the frequencies of the pre-token in every document,
and summed; ids of a document are never held.

Documents form blocks of consecutive rows. A block sends one row for each of its pre-tokens: the
pre-token and a posting list, two bytes for each occurrence, that say in which document of the
block it is. These rows are dealt out and ordered by pre-token, so each distinct one is counted
where all its posting lists are, and sums per document go back to the block.

Frequent pre-tokens would be the hot keys of that exchange. A Misra-Gries summary of each task
finds them; those whose share of the summaries is at least their length over ``HOT_BYTES`` are
counted first and sent to the tasks, where their part of the sums is made in place. As shares add
up to one, they never hold more than ``HOT_BYTES`` bytes, whatever the corpus; which pre-tokens
they are changes no result.

Defined cases: a NULL or empty text has 0 bytes and 0 tokens; a NULL key stays NULL; texts and
pre-tokens of any length are counted whole; repeated rows give repeated results; an empty table
gives an empty one; other columns do not matter, whatever their names. The rows must come in the
same order when a lost task runs again, as they do from files and written tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelake.llm.common import column, text_of
from tidelake.session import written

MARK = "▁"
FEED = "\n"
# Bytes of pre-tokens that travel to every task.
HOT_BYTES = 2 << 20
# Pre-tokens in the summary of a task.
COUNTERS = 200_000
# A block ends when it has this many pre-tokens, occurrences or documents.
BLOCK_UNITS = 400_000
BLOCK_POSTINGS = 4_000_000
BLOCK_ROWS = 1 << 16
# Sums of documents that a task gathers before it passes them on.
GATHERED = 1_000_000

_UNITS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a whole text, in order; blanks are marks, and one stands first."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return _UNITS.findall(MARK + text.replace(" ", MARK))
    return [u for u in (MARK + text.replace(" ", " " + MARK).replace(FEED, " \n ")).split(" ") if u]


def frequencies(text: str) -> Counter[str]:
    return Counter(pre_tokens(text))


class PieceCounter:
    """Pieces of single pre-tokens, as the library makes them inside a text."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        if any(len(p) > 1 and (FEED in p or MARK in p.lstrip(MARK)) for p in pieces):
            raise ValueError("pieces that span words or lines are not supported")
        # The library adds a mark at the begin of a text, which stands before a line feed here.
        self.lead = len(self.library.encode(FEED))

    def counts(self, units: list[str]) -> list[int]:
        """A line feed ends whatever stands before it, so each unit follows one."""
        texts = [FEED + u.replace(MARK, " ") for u in units]
        return [len(ids) - self.lead for ids in self.library.encode(texts, num_threads=1)]


def _pruned(found: Counter[str], size: int) -> Counter[str]:
    """The Misra-Gries summary: counts less the largest one that has no place."""
    if len(found) <= size:
        return found
    less = sorted(found.values(), reverse=True)[size]
    return Counter({unit: n - less for unit, n in found.items() if n > less})


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found.update(pre_tokens(text))
            if len(found) > 2 * COUNTERS:
                found = _pruned(found, COUNTERS)
    found = _pruned(found, COUNTERS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
        names=["unit", "uses"],
    )


def hot_units(texts: DataFrame, model: bytes, hot_bytes: int = HOT_BYTES) -> dict[str, int]:
    """Piece counts of the frequent pre-tokens: at most ``hot_bytes`` bytes of them."""
    found = written(
        texts.mapInArrow(_summary, "unit string, uses long").groupBy("unit").agg(
            F.sum("uses").alias("uses")
        ),
        "frequent",
    )
    total = found.agg(F.sum("uses")).first()[0] or 0
    share = F.col("uses").cast("double") * hot_bytes >= F.octet_length("unit").cast("double") * total

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for batch in batches:
            pieces = pa.array(counter.counts(batch.column("unit").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pieces], names=["unit", "pieces"])

    table = found.where(share).select("unit").mapInArrow(count, "unit string, pieces long").toArrow()
    return dict(zip(table.column("unit").to_pylist(), table.column("pieces").to_pylist()))


class _Block:
    """Posting lists of the documents of a block, and what is known of each document."""

    def __init__(self, key_type: pa.DataType):
        self.key_type = key_type
        self.lists: dict[str, bytearray] = {}
        self.keys: list = []
        self.sizes: list[int] = []
        self.sums: list[int] = []
        self.postings = 0

    def add(self, key, text: str, size: int, hot: dict[str, int]) -> None:
        spot, total = len(self.keys).to_bytes(2, "little"), 0
        for unit, n in frequencies(text).items():
            pieces = hot.get(unit)
            if pieces is None:
                self.lists.setdefault(unit, bytearray()).extend(spot * n)
                self.postings += n
            else:
                total += n * pieces
        self.keys.append(key)
        self.sizes.append(size)
        self.sums.append(total)

    def full(self) -> bool:
        return (
            len(self.lists) >= BLOCK_UNITS
            or self.postings >= BLOCK_POSTINGS
            or len(self.keys) == BLOCK_ROWS
        )

    def rows(self, block: str) -> pa.RecordBatch:
        """A row for each pre-token, and one for the documents, with a unit that nothing else has."""
        rest = len(self.lists)
        lists = pa.array([*map(bytes, self.lists.values()), None], pa.binary())
        none = [None] * rest
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*self.lists, f" {block}"], pa.string()),
                pa.array([block] * (rest + 1), pa.string()),
                lists,
                pa.array([*none, self.keys], pa.list_(self.key_type)),
                pa.array([*none, self.sizes], pa.list_(pa.int64())),
                pa.array([*none, self.sums], pa.list_(pa.int64())),
            ],
            names=["unit", "block", "postings", "keys", "sizes", "sums"],
        )


def _posted(hot: dict[str, int]):
    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, part = None, 0, None
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            names = ("key", "text", "n_bytes")
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                block = block or _Block(batch.column("key").type)
                block.add(*row, hot)
                if block.full():
                    yield block.rows(f"{part}-{at}")
                    block, at = None, at + 1
        if block:
            yield block.rows(f"{part}-{at}")

    return per_block


class _Sums:
    """Sums of documents, by block."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, blocks: pa.Array, lists: pa.Array, pieces: np.ndarray) -> None:
        coded = blocks.dictionary_encode()
        names = [self.names.setdefault(b, len(self.names)) for b in coded.dictionary.to_pylist()]
        number = np.array(names)[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = pc.binary_length(lists).to_numpy(zero_copy_only=False) // 2
        spots = np.frombuffer(b"".join(lists.to_pylist()), dtype="<u2").astype(np.int64)
        place, inverse = np.unique(np.repeat(number, sizes) * BLOCK_ROWS + spots, return_inverse=True)
        sums = np.bincount(inverse, weights=np.repeat(pieces, sizes), minlength=len(place))
        self.found.append((place, sums.astype(np.int64)))
        self.size += len(place)
        if len(self.found) >= 64:
            self._join()

    def _join(self) -> None:
        places = np.concatenate([p for p, _ in self.found])
        place, inverse = np.unique(places, return_inverse=True)
        sums = np.zeros(len(place), dtype=np.int64)
        np.add.at(sums, inverse, np.concatenate([s for _, s in self.found]))
        self.found, self.size = [(place, sums)], len(place)

    def rows(self) -> list[tuple[str, bytes]]:
        """A row for each block: numbers of documents and their sums."""
        if not self.found:
            return []
        self._join()
        (place, sums), names = self.found[0], list(self.names)
        number = place // BLOCK_ROWS
        cuts = np.flatnonzero(np.diff(number)) + 1
        rows = [
            (names[p[0] // BLOCK_ROWS], (p % BLOCK_ROWS).astype("<u2").tobytes() + s.astype("<u4").tobytes())
            for p, s in zip(np.split(place, cuts), np.split(sums, cuts))
        ]
        self.__init__()
        return rows


def _counted(model: bytes, schema: pa.Schema):
    """Rows of a pre-token come side by side, so each one is counted when it is first met."""

    def per_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, sums, last = PieceCounter(model), _Sums(), (None, 0)
        for batch in batches:
            known = batch.filter(batch.column("keys").is_valid())
            if known.num_rows:
                parts = pa.nulls(known.num_rows, pa.binary())
                columns = [known.column(c) for c in ("block", "keys", "sizes", "sums")]
                yield pa.RecordBatch.from_arrays([*columns, parts], schema=schema)
            rest = batch.filter(batch.column("postings").is_valid())
            if not rest.num_rows:
                continue
            units = rest.column("unit")
            begin = np.ones(len(units), dtype=bool)
            begin[1:] = pc.not_equal(units[1:], units[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(begin)
            names = units.take(pa.array(starts)).to_pylist()
            fresh = names[1:] if names[0] == last[0] else names
            pieces = [last[1]] * (len(names) - len(fresh)) + counter.counts(fresh)
            last = (names[-1], pieces[-1])
            each = np.repeat(pieces, np.diff(np.append(starts, len(units))))
            sums.add(rest.column("block"), rest.column("postings"), each)
            if sums.size >= GATHERED:
                yield _partial(sums.rows(), schema)
        yield _partial(sums.rows(), schema)

    return per_unit


def _partial(rows: list[tuple[str, bytes]], schema: pa.Schema) -> pa.RecordBatch:
    none = [pa.nulls(len(rows), schema.field(c).type) for c in ("keys", "sizes", "sums")]
    blocks, parts = [pa.array([r[i] for r in rows], schema.field(c).type) for i, c in ((0, "block"), (1, "parts"))]
    return pa.RecordBatch.from_arrays([blocks, *none, parts], schema=schema)


def _summed(key: str):
    def per_block(rows: pa.Table) -> pa.Table:
        known = rows.filter(rows.column("keys").is_valid())
        keys, sizes = (known.column(c)[0].values for c in ("keys", "sizes"))
        tokens = known.column("sums")[0].values.to_numpy(zero_copy_only=False).copy()
        for part in rows.column("parts").drop_null().to_pylist():
            n = len(part) // 6
            # Each document is named once in a part.
            tokens[np.frombuffer(part, "<u2", n)] += np.frombuffer(part, "<u4", n, 2 * n)
        return pa.table({key: keys, "n_bytes": sizes, "n_tokens": pa.array(tokens, pa.int64())})

    return per_block


def token_counts(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: its key (under that name), n_bytes and n_tokens.

    The model file is read once on the driver and travels with the plan (half a megabyte).
    """
    with open(model_path, "rb") as f:
        model = f.read()
    whole, kind = text_of(docs, text), docs.schema[key].dataType
    hot = hot_units(docs.select(whole.alias("text")), model)
    lists = f"keys array<{kind.simpleString()}>, sizes array<long>, sums array<long>"
    posted = docs.select(
        column(docs, key).alias("key"),
        whole.alias("text"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("part"),
    ).mapInArrow(_posted(hot), f"unit string, block string, postings binary, {lists}")
    schema = f"block string, {lists}, parts binary"
    # Equal pre-tokens need only be side by side, and hashes are quicker to order than texts.
    ordered = posted.repartition("unit").sortWithinPartitions(F.xxhash64("unit"), "unit")
    counted = ordered.mapInArrow(_counted(model, _arrow(schema)), schema)
    result = f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long"
    return counted.groupBy("block").applyInArrow(_summed(key), result)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))
