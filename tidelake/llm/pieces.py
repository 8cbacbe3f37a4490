"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding starts from single characters and keeps an agenda of adjacent pairs whose joint piece
is in the vocabulary, ordered by score and then by position; the best pair is merged and its
new neighbours enter the agenda, until it is empty. Characters outside the vocabulary become
byte pieces. As no piece holds a space mark after another character, and some characters occur
in no longer piece, a text falls into units that never merge with each other; each distinct
short unit is merged once and then remembered. Decoding joins pieces and byte runs.

In each Arrow batch the sentencepiece library encodes and decodes the units that are new there,
and ``agrees`` says of a row whether it confirmed all of them; whole texts are compared in the
tests. Many short units are merged side by side in arrays: in each round every unit merges the
head of its agenda. Longer units keep a heap.

Defined cases: a NULL or empty text has the begin and end ids only and decodes to the empty
text; texts of any length are encoded whole; repeated rows give repeated results; an empty table
gives an empty one; other columns pass through, but those named like a result give way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain, groupby
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import column, text_of

MARK = "▁"
# A worker remembers about this many units; those up to SHORT characters are merged side by
# side, TOGETHER at a time.
MEMORY = 400_000
SHORT = 64
TOGETHER = 4096
FAR = np.iinfo(np.int64).max
# Agenda entries keep the position in their low bits.
SHIFT = 40
LOW = (1 << SHIFT) - 1


class MergeVocabulary:
    """Pieces, scores and special ids of a merge-type model."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, size = self.library, self.library.get_piece_size()
        if any(lib.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.shown: list[str] = []
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                code = int(piece[3:5], 16)
                self.bytes[code] = i
                self.shown.append(chr(code))
            elif lib.is_control(i):
                self.shown.append("")
            elif lib.is_unknown(i):
                self.shown.append(" ⁇ ")
            else:
                self.ids[piece] = i
                self.shown.append(piece.replace(MARK, " "))
        # Pieces of one score share a place; the better the score, the smaller the place.
        scores = sorted({-lib.get_score(i) for i in self.ids.values()})
        order = {score: at for at, score in enumerate(scores)}
        self.place = {p: order[-lib.get_score(i)] for p, i in self.ids.items()}
        # Ids of bytes beyond ASCII: only runs with one of these need decoding as UTF-8.
        self.high = frozenset(i for code, i in self.bytes.items() if code > 127)
        self.marked = frozenset(i for p, i in self.ids.items() if p.startswith(MARK))
        self.byte_of = {i: code for code, i in self.bytes.items()}
        longer = [p for p in self.ids if len(p) > 1]
        if any("\n" in p or MARK in p.lstrip(MARK) for p in longer):
            raise ValueError("pieces that span words or lines are not supported")
        self.units = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self._tabulate(size, longer)
        self.known: dict[str, tuple[int, ...]] = {"": ()}
        self.agreed: dict[str, bool] = {"": True}

    def merge(self, unit: str) -> tuple[int, ...]:
        """Ids of one unit, by the agenda of adjacent pairs.

        An entry is one number: the place of the joint piece by score, then the position. It is
        out of date if the pair that now stands there has another place.
        """
        place, size = self.place.get, len(unit)
        parts, after, before = list(unit), list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = [
            found << SHIFT | i
            for i, joint in enumerate(map(add, unit, unit[1:]))
            if (found := place(joint)) is not None
        ]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            entry = pop(agenda)
            left = entry & LOW
            right, first = after[left], parts[left]
            if right >= size or not first:
                continue
            joint = first + parts[right]
            if place(joint) != entry >> SHIFT:
                continue
            parts[left], parts[right] = joint, ""
            beyond = after[left] = after[right]
            if beyond < size:
                before[beyond] = left
                if (found := place(joint + parts[beyond])) is not None:
                    push(agenda, found << SHIFT | left)
            previous = before[left]
            if previous >= 0 and (found := place(parts[previous] + joint)) is not None:
                push(agenda, found << SHIFT | previous)
        ids: list[int] = []
        for part in filter(None, parts):
            found = self.ids.get(part)
            if found is not None:
                ids.append(found)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in part.encode("utf-8"))
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def _tabulate(self, size: int, longer: list[str]) -> None:
        """Arrays for merging many units at once: symbols of characters, and joinable pairs.

        Symbols are ids; characters that are no piece follow after them.
        """
        self.size = size
        symbols = dict(self.ids)
        self.symbol = np.arange(0x110000, dtype=np.int64) + size
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        for char in {c for p in longer for c in p}:
            symbols.setdefault(char, ord(char) + size)
        pairs = sorted(
            (symbols[p[:k]] << 32 | symbols[p[k:]], self.place[p], self.ids[p])
            for p in longer
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        )
        self.pair, self.pair_place, self.pair_id = np.array(pairs, dtype=np.int64).T.copy()

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and id of joint pieces; the place is FAR where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_place[at], FAR), self.pair_id[at]

    def merge_all(self, units: list[str]) -> None:
        """Merge units of one length side by side, the best pair of each unit in every round."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = self.symbol[points.reshape(len(units), -1)]
        rows = np.arange(len(units))
        places, _ = self._look_up(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            width = symbols.shape[1]
            best = places.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            going = places[line, best] < FAR if width > 1 else np.zeros(len(rows), bool)
            ready = symbols[~going]
            odd = (ready >= self.size).any(axis=1).tolist()
            for row, ids, strange in zip(rows[~going].tolist(), ready.tolist(), odd):
                self.known[units[row]] = tuple(self._resolve(ids) if strange else ids)
            rows, symbols, places, best = rows[going], symbols[going], places[going], best[going]
            if not len(rows):
                return
            line = line[: len(rows)]
            _, joint = self._look_up(symbols[line, best], symbols[line, best + 1])
            columns = np.arange(width - 1)
            shift = columns + (columns > best[:, None])
            symbols = np.take_along_axis(symbols, shift, axis=1)
            symbols[line, best] = joint
            places = np.take_along_axis(places, shift[:, : width - 2], axis=1)
            for at in (best - 1, best):  # the pairs on both sides of the merged piece
                some = np.nonzero((at >= 0) & (at < width - 2))[0]
                near = at[some]
                places[some, near], _ = self._look_up(symbols[some, near], symbols[some, near + 1])

    def _resolve(self, symbols: list[int]) -> list[int]:
        """Ids of symbols; a character that is no piece becomes bytes, or the unknown id."""
        ids = []
        for symbol in symbols:
            if symbol < self.size:
                ids.append(symbol)
            elif self.bytes:
                char = chr(symbol - self.size).encode("utf-8", "surrogatepass")
                ids.extend(self.bytes[b] for b in char)
            else:
                ids.append(self.unknown)
        return ids

    def split(self, text: str) -> list[str]:
        """The units of a text: runs of marks with the characters after them, and line feeds."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return self.units.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")

    def learn(self, units: set[str]) -> None:
        """Merge the units that are not yet known, and hold them against the library.

        A unit that begins with a mark stands at the begin of a text for the library, which adds
        the mark; any other one stands behind a line feed.
        """
        if len(self.known) + len(units) > MEMORY:
            self.known, self.agreed = {"": ()}, {"": True}
        new = sorted((u for u in units if u not in self.known), key=len)
        for length, group in groupby(new, key=len):
            if length > SHORT:
                self.known.update((u, self.merge(u)) for u in group)
                continue
            group = list(group)
            for at in range(0, len(group), TOGETHER):
                self.merge_all(group[at : at + TOGETHER])
        feed = self.known.get("\n") or self.merge("\n")
        for at in range(0, len(new), TOGETHER):
            some = [u for u in new[at : at + TOGETHER] if u != "\n"]
            whole = "\n".join(u.replace(MARK, " ") for u in some)
            ours = [self.ids[MARK], *feed]
            for u in some:
                ours += self.known[u]
                ours += feed
            theirs = self.library.encode("\n" + whole + "\n")
            same = theirs == ours and self.library.decode(theirs) == "\n" + whole + "\n"
            for u in some:
                self.agreed[u] = same or self._agrees(u, feed)

    def _agrees(self, unit: str, feed: tuple[int, ...]) -> bool:
        theirs = self.library.encode("\n" + unit.replace(MARK, " "))
        return theirs == [self.ids[MARK], *feed, *self.known[unit]]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text between the begin and the end id."""
        units = self.split(text)
        self.learn(set(units))
        return self.join(units)

    def join(self, units: list[str]) -> list[int]:
        return [self.begin, *chain.from_iterable(map(self.known.__getitem__, units)), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are blanks, one blank at the begin goes, bytes join to UTF-8."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                code = self.byte_of.get(i)
                if code is not None:
                    run.append(code)
                    continue
                if run:
                    out.append(_characters(run))
                    run = bytearray()
                out.append(self.shown[i])
            text = "".join([*out, _characters(run)])
        first = next((i for i in ids if self.shown[i]), None)
        return text[1:] if first in self.marked else text


def _characters(run: bytearray) -> str:
    """UTF-8 of a run of bytes; each byte that starts no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        lead = run[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(bytes(run[at : at + width]).decode("utf-8"))
            at += width
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


RESULT = pa.struct(
    [
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
        ("agrees", pa.bool_()),
    ]
)
RESULT_TYPE = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("agrees", T.BooleanType()),
    ]
)


def _digests(vocabulary: MergeVocabulary, texts: list[str]) -> list[dict]:
    split = [vocabulary.split(text) for text in texts]
    rows = []
    for some in _groups(split):
        vocabulary.learn({u for units in some for u in units})
        agreed = vocabulary.agreed
        for units in some:
            ids = vocabulary.join(units)
            decoded = vocabulary.decode(ids)
            rows.append(
                {
                    "n_tokens": len(ids),
                    "ids_sha256": hashlib.sha256(_packed(ids)).hexdigest(),
                    "decoded_sha256": hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
                    "agrees": all(agreed.get(u, True) for u in units),
                }
            )
    return rows


def _groups(split: list[list[str]]):
    """Runs of texts that hold at most about MEMORY / 2 units, or one text."""
    start, size = 0, 0
    for i, units in enumerate(split):
        if i > start and size + len(units) > MEMORY // 2:
            yield split[start:i]
            start, size = i, 0
        size += len(units)
    if start < len(split):
        yield split[start:]


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if packed.itemsize != 4:
        raise ValueError("32-bit unsigned numbers are needed")
    return packed.tobytes()


def encoder(model: bytes):
    """A column function from text to RESULT_TYPE for one model."""

    @F.arrow_udf(RESULT_TYPE)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = MergeVocabulary(model)
        for batch in batches:
            yield pa.array(_digests(vocabulary, batch.to_pylist()), type=RESULT)

    return encode


def encode_documents(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` (but those named like a result) with the results.

    The model file is read once on the driver and travels with the plan (half a megabyte).
    """
    with open(model_path, "rb") as f:
        encode = encoder(f.read())
    plain = [c for c in docs.columns if c not in RESULT_TYPE.names]
    held = {f"_in{i}": column(docs, c) for i, c in enumerate(plain)}
    out = docs.select(
        *[c.alias(name) for name, c in held.items()], encode(text_of(docs, text)).alias("_out")
    )
    return out.select(
        *[F.col(name).alias(c) for name, c in zip(held, plain)],
        *[F.col(f"_out.{c}").alias(c) for c in RESULT_TYPE.names],
    )
