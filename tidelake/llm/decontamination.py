"""Benchmark decontamination by template windows.

A text becomes a template: its words in lower case without marks at their ends, where numbers,
units and names are replaced by typed placeholders. A name is a word with a capital that does
not begin a sentence. Windows of ``WINDOW`` template words of the benchmark are joined by hash
with those of the documents. In a matched window the values behind the placeholders are compared
slot by slot: a question whose numbers or names were changed maps each old value to one new
value, so a match whose values map one value to several is not consistent.

A document leaks an item if at least ``LEAST_WINDOWS`` of the item's windows match, or half of
them for an item with fewer, along one shift, and at most ``MAX_CONFLICTS`` of the pairs of an
old and a new value are surplus, that is beyond the first new value of an old one. Windows with
fewer than ``LEAST_WORDS`` literal words match too easily and are not used. Items shorter than a
window are matched whole, if they have ``SHORTEST`` words.

Items without a window that can be used (short ones, lists of names or numbers, scripts without
blanks) are matched by their letters and digits as they are: every window of ``CHARS`` of them must
match along one shift, so only an exact copy counts; an item with fewer must be a whole line of the
document. An item without any letter or digit is never found.

Most windows of documents match nothing. A Bloom filter of fixed size (``FILTER_BITS``, so
whatever the benchmark holds, a few megabytes are sent) takes them out before the shuffle; what
it lets through is decided by the join.

Defined cases: NULL texts are empty; empty texts, an empty table and an empty benchmark give no
rows; texts of any length are searched whole; repeated rows count once; equal items are each
reported; ids may be of any simple type, and a NULL id of a document or item is reported as NULL;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import column, text_of
from tidelake.session import written

WINDOW = 8
SHORTEST = 5
LEAST_WORDS = 4
LEAST_WINDOWS = 6
MAX_CONFLICTS = 0.2
FILTER_BITS = 26
MEMORY = 250_000
# Letters and digits of a window of an item that has no other one. Rows of such windows carry
# the size EXACT, and those of whole lines the size LINE.
CHARS = 12
EXACT, LINE = -CHARS, 0

LITERAL, NUMBER, UNIT, NAME = range(4)
# Units of measure and money.
UNITS = frozenset(
    "mm cm km mg kg ml sec min hr mph kmh ms hz khz mhz ghz kw mw kj cal kcal"
    " bar mb gb tb kb percent pct dollar dollars euro euros cent cents pound pounds"
    " inch inches foot feet yard yards mile miles meter meters metre metres gram grams kilogram"
    " kilograms liter liters litre litres hour hours minute minutes second seconds day days week"
    " weeks month months year years".split()
)
EDGES = "\"'`.,;:!?()[]{}<>«»“”‘’…-–—*_"
ENDS = re.compile(r"[.!?][\"')\]»”’]*$")
UNSAID = re.compile(r"[\W_]+")
DIGITS = re.compile(r"[-+$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Templates:
    """Template words of texts; what a word is, apart from its place, is remembered."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.words: list[str] = []
        self._grow(1024)

    def _grow(self, size: int) -> None:
        """Arrays of hash, kind, capital and sentence end by word, with room for ``size``."""
        old = getattr(self, "_hash", None) if self.words else None
        fresh = [np.zeros(size, kind) for kind in (np.uint64, np.int8, bool, bool)]
        if old is not None:
            for new, kept in zip(fresh, (self._hash, self._kind, self._capital, self._ending)):
                new[: len(kept)] = kept
        self._hash, self._kind, self._capital, self._ending = fresh

    def _add(self, raw: str) -> int:
        word = raw.strip(EDGES)
        low = word.lower() or raw
        if DIGITS.fullmatch(word):
            kind = NUMBER
        elif low in UNITS or raw in ("%", "$", "€", "£"):
            kind = UNIT
        else:
            kind = LITERAL
        at = self.index[raw] = len(self.words)
        if at == len(self._hash):
            self._grow(2 * at)
        self.words.append(low)
        self._hash[at] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
        self._kind[at] = kind
        self._capital[at] = word[:1].isupper()
        self._ending[at] = ENDS.search(raw) is not None
        return at

    def of(self, text: str, begins: bool = True) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(template hash, kind) of each word, and the index of the word itself.

        ``begins`` says whether the first word begins a sentence.
        """
        if len(self.words) > MEMORY:
            self.clear()
        known, add = self.index, self._add
        at = [known[w] if w in known else add(w) for w in text.split()]
        if not at:
            return np.empty(0, np.uint64), np.empty(0, np.int8), at
        place = np.array(at)
        kinds = self._kind[place]
        first = np.concatenate(([begins], self._ending[place][:-1]))
        kinds = np.where((kinds == LITERAL) & self._capital[place] & ~first, NAME, kinds)
        hashes = np.where(kinds == LITERAL, self._hash[place], kinds.astype(np.uint64))
        return hashes, kinds, at

    def windows(
        self, text: str, size: int, begins: bool = True
    ) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
        """(starts, hashes) of usable windows of ``size`` words; index and kind of the words."""
        hashes, kinds, at = self.of(text, begins)
        n = len(at) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), [], kinds
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total = (total ^ hashes[k : k + n]) * MULTIPLIER
            total ^= total >> np.uint64(29)
        literal = np.concatenate(([0], np.cumsum(kinds == LITERAL)))
        usable = np.nonzero(literal[size:] - literal[:-size] >= min(LEAST_WORDS, size))[0]
        return usable, total[usable], at, kinds


def said(text: str) -> str:
    """The letters and digits of a text, in lower case."""
    return UNSAID.sub("", text.lower())


def exact_windows(text: str) -> np.ndarray:
    """Hashes of the windows of ``CHARS`` letters and digits, one for each place."""
    points = np.frombuffer(said(text).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(points) - CHARS + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, CHARS, np.uint64)
    for k in range(CHARS):
        total = (total ^ (points[k : k + n].astype(np.uint64) + np.uint64(4))) * MULTIPLIER
        total ^= total >> np.uint64(29)
    return total


def lines(text: str) -> np.ndarray:
    """Hashes of the letters and digits of each line, 0 for a line without."""
    each = [said(line) for line in text.split("\n")]
    hashes = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) if x else 0 for x in each]
    return np.array(hashes, dtype=np.uint64)


SLOTS = pa.list_(pa.string())
WINDOW_ROWS = pa.schema(
    [("id", pa.string()), ("size", pa.int32()), ("start", pa.int32()), ("n", pa.int32()),
     ("hash", pa.int64()), ("slots", SLOTS)]
)
WINDOW_TYPE = "id string, size int, start int, n int, hash long, slots array<string>"


def _positions(hashes: np.ndarray) -> list[np.ndarray]:
    low = np.uint64((1 << FILTER_BITS) - 1)
    return [hashes >> np.uint64(64 - FILTER_BITS), hashes & low]


def _in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for p in _positions(hashes):
        word = bits[(p >> np.uint64(6)).astype(np.int64)]
        hit &= (word >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


class _Rows:
    """Window rows of one batch."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits
        self.out: list[list] = [[] for _ in WINDOW_ROWS]

    def add(self, key, size: int, starts: np.ndarray, hashes: np.ndarray, slots, n=None) -> int:
        """Windows that pass the filter; ``slots`` gives the values of the one at a place."""
        if self.bits is not None and len(hashes):
            hit = _in_filter(self.bits, hashes)
            starts, hashes = starts[hit], hashes[hit]
        n = len(starts) if n is None else n
        for s, h in zip(starts.tolist(), hashes.view(np.int64).tolist()):
            for values, v in zip(self.out, (key, size, s, n, h, slots(s))):
                values.append(v)
        return n

    def add_templates(self, templates: Templates, key, text: str, size: int, again=None) -> int:
        """The windows of a text. ``again`` adds the first one as it is inside a sentence; the
        windows of the text are as many as that says."""
        starts, hashes, at, kinds = templates.windows(text, size, again is None)
        if again is not None:
            starts, hashes = starts[starts == 0], hashes[starts == 0]
        return self.add(key, size, starts, hashes, lambda s: [
            f"{kinds[i]}:{templates.words[at[i]]}" for i in range(s, s + size) if kinds[i] != LITERAL
        ], again)

    def add_exact(self, key, text: str) -> int:
        hashes = exact_windows(text)
        return self.add(key, EXACT, np.arange(len(hashes)), hashes, lambda s: [])

    def add_lines(self, key, text: str) -> int:
        hashes = lines(text)
        at = np.flatnonzero(hashes)
        return self.add(key, LINE, at, hashes[at], lambda s: [])

    def add_item(self, templates: Templates, key, text: str) -> None:
        """An item by its templates, or else by its letters and digits, or else as one line."""
        size = min(WINDOW, len(text.split()))
        if size >= SHORTEST and (n := self.add_templates(templates, key, text, size)):
            # A document may hold the item behind a colon or a line without a full stop, where
            # its first word looks like a name.
            if text.split()[0].strip(EDGES)[:1].isupper():
                self.add_templates(templates, key, text, size, again=n)
            return
        if not self.add_exact(key, text):
            self.add_lines(key, text.replace("\n", " "))

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(v, type=f.type) for v, f in zip(self.out, WINDOW_ROWS)]
        return pa.RecordBatch.from_arrays(columns, schema=WINDOW_ROWS)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = Templates()
    for batch in batches:
        rows = _Rows(None)
        for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
            rows.add_item(templates, key, text)
        yield rows.batch()


def _document_rows(sizes: list[int], bitmap: bytes):
    """mapInArrow function from (id, text) to windows; those not in the filter are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        bits = np.frombuffer(bitmap, dtype="<u8")
        for batch in batches:
            rows = _Rows(bits)
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                for size in sizes:
                    if size == EXACT:
                        rows.add_exact(key, text)
                    elif size == LINE:
                        rows.add_lines(key, text)
                    else:
                        rows.add_templates(templates, key, text, size)
            yield rows.batch()

    return run


def _filter_of(windows: DataFrame) -> bytes:
    """Bloom filter of the window hashes: at most 2 ** (FILTER_BITS - 6) words reach the driver."""
    high = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    low = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    at = windows.select(F.explode(F.array(high, low)).alias("p"))
    words = at.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")
    )
    table = words.toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype="<i8")
    bitmap[table["w"].to_numpy()] = table["bits"].to_numpy()
    return bitmap.tobytes()


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots, n_changed, n_conflicts): one row for
    each document and item that it leaks. ``n_slots`` counts the pairs of slot values,
    ``n_changed`` the item's values that the document has replaced, ``n_conflicts`` the surplus
    pairs."""
    items = benchmark.select(
        column(benchmark, item).cast("string").alias("id"),
        text_of(benchmark, item_text).alias("text"),
    )
    known = written(
        items.distinct().mapInArrow(_item_rows, WINDOW_TYPE), "item-windows"
    )
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    bitmap = _filter_of(known)
    rows = docs.select(
        column(docs, key).cast("string").alias("id"), text_of(docs, text).alias("text")
    )
    seen = rows.mapInArrow(_document_rows(sizes, bitmap), WINDOW_TYPE)
    # What the filter lets through is about as large as the leaks; the join takes it from here.
    seen = written(
        seen.select(F.col("id").alias("doc_id"), "size", "start", "hash", "slots"), "doc-windows"
    )
    wanted = known.select(
        F.col("id").alias("item_id"),
        "size",
        F.col("start").alias("item_start"),
        F.col("n").alias("item_windows"),
        "hash",
        F.col("slots").alias("item_slots"),
    )
    met = seen.join(wanted, ["size", "hash"]).withColumn(
        "shift", F.col("start") - F.col("item_start")
    )
    met = written(met.select("doc_id", "item_id", "size", "item_windows", "shift", "item_start",
                             F.arrays_zip("item_slots", "slots").alias("slots")), "matches")
    run = ["doc_id", "item_id", "size", "item_windows", "shift"]
    enough = F.when(F.col("size") == EXACT, F.col("item_windows")).otherwise(
        F.least(F.lit(LEAST_WINDOWS), F.col("item_windows") / 2)
    )
    counted = (
        met.select(*run, "item_start")
        .distinct()
        .groupBy(*run)
        .agg(F.count("*").alias("n_windows"))
        .filter(F.col("n_windows") >= enough)
    )
    values = (
        met.select(*run, F.explode("slots").alias("slot"))
        .select(*run, F.col("slot.item_slots").alias("old"), F.col("slot.slots").alias("new"))
        .distinct()
        .groupBy(*run, "old")
        .agg(F.count("*").alias("n"), F.max(F.col("old") != F.col("new")).alias("changed"))
        .groupBy(*run)
        .agg(
            F.sum("n").alias("n_slots"),
            F.sum(F.col("changed").cast("long")).alias("n_changed"),
            F.sum(F.col("n") - 1).alias("n_conflicts"),
        )
    )
    same = [counted[c].eqNullSafe(values[c]) for c in run]
    judged = counted.join(values, same, "left").select(
        *[counted[c] for c in run],
        "n_windows",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_slots", "n_changed", "n_conflicts")],
    )
    judged = judged.filter(F.col("n_conflicts") <= MAX_CONFLICTS * F.col("n_slots"))
    best = F.max(
        F.struct("n_windows", F.negate("n_conflicts").alias("c"), F.negate("n_changed").alias("d"),
                 "item_windows", "n_slots")
    )
    out = judged.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select(
        F.col("doc_id").cast(docs.schema[key].dataType).alias("doc_id"),
        F.col("item_id").cast(benchmark.schema[item].dataType).alias("item_id"),
        F.col("b.n_windows").cast("long").alias("n_windows"),
        F.col("b.item_windows").cast("long").alias("item_windows"),
        F.col("b.n_slots").alias("n_slots"),
        F.negate("b.d").alias("n_changed"),
        F.negate("b.c").alias("n_conflicts"),
    )


def keep_clean(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    leaked = found.select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, column(docs, key).eqNullSafe(leaked["_leaked"]), "left_anti")
