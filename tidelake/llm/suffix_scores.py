"""Scores of whole texts by the suffix tree of ``suffix_tree``, without writing the tree out.

With contexts of two words, every count that a token's chance needs has the word before the token
in the middle of its three words: the pairs (b, c), the contexts (a, b) and the triples (a, b, c).
So all occurrences of a middle word b are brought together once. There its followers are counted,
the divergence tests of b and of every (a, b) are made, and each occurrence gets its token's log
chance less that under the root; the sums go back to the rows. Nothing seen once leaves a table.

1. ``_read_blocks`` numbers the words of blocks of texts; codes and words are a written table.
2. ``_number`` counts each word over all blocks and answers every block with the number and count
   of its words, frequent ones first. Words seen once get no number: no context or kept follower
   can hold one.
3. ``_occurrences`` looks up a block's words and sends its occurrences to the bin of the middle
   word, as sorted columns of triples and rows.
4. ``_judge_bins`` counts, tests and scores bin by bin, and answers every block with sums by row.
5. ``_add_up`` adds these to the sums under the root.

A middle word seen more than ``HOT`` times is dealt out over bins by the word before it, in parts
of about ``PART`` occurrences (at most 257). Its pairs are counted before (``_hot_pairs``,
``_merge_pairs``); each bin gets those that it holds, and the word's state comes from sums over
all. A bin is read twice, blob by blob, so a frequent context needs memory for what is distinct in
it and for its packed rows. Only hot words and their states reach the driver, at most one for
``HOT`` training tokens. None of these sizes changes a score.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import column, text_of
from tidelake.session import written

LEAST = 2  # times that a context or a follower must be seen
GAIN = 0.02
END = b" "  # no word holds a blank
LN10 = float(np.log(10.0))

BLOCK = 3 << 20  # tokens after which a block of texts is closed
WORD_BINS = 256  # by the first byte of the hash
HOT = 1 << 20  # occurrences of a middle word that one bin takes whole
PART = 1 << 18  # occurrences of a more frequent one that a bin takes, about
BIN = 1 << 18  # training tokens of a bin, while there are few
SORTED = 1 << 20  # occurrences sorted at once

# Kinds of rows.
CODES, ANSWER, TOTALS, COUNTS, BASE, TRIPLES, PAIRS, SUMS = range(8)
PACKED = "key long, block long, kind int, data binary"
SCHEMA = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words of a UTF-8 text and the end token."""
    return [*text.lower().split(), END]


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of numbers of at least zero, or of doubles, in planes of bytes."""
    codec, head, body = pa.Codec("zstd", compression_level=1), [len(arrays)], []
    for a in arrays:
        if a.dtype.kind == "f":
            width, kind = 8, -8
            raw = np.ascontiguousarray(a, "<f8")
        else:
            most = int(a.max()) if len(a) else 0
            width = kind = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
            raw = a.astype(f"<u{width}")
        planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, width).T)
        body.append(codec.compress(planes.tobytes(), asbytes=True) if len(a) else b"")
        head += [kind, len(a), len(body[-1])]
    return b"".join([np.array(head, "<i8").tobytes(), *body])


def unpack(data: bytes, *wanted: int) -> list[np.ndarray]:
    """These columns of a packed row, or all."""
    codec = pa.Codec("zstd", compression_level=1)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 3 * n, 8).reshape(n, 3).tolist()
    at, out = 8 + 24 * n, []
    for k, (kind, length, size) in enumerate(head):
        if not wanted or k in wanted:
            width = abs(kind)
            raw = b""
            if length:
                raw = codec.decompress(data[at : at + size], length * width, asbytes=True)
            a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1)
            out.append(a.view("<f8") if kind < 0 else a.view(f"<u{width}").astype(np.int64))
        at += size
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted column; its running sum gives it back."""
    return np.diff(a, prepend=a.dtype.type(0))


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*found)) or [[]] * len(SCHEMA)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new row begins in columns sorted together."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for a in columns:
        new[1:] |= a[1:] != a[:-1]
    return np.nonzero(new)[0]


def _bin_of(word: np.ndarray, part: np.ndarray, bins: int) -> np.ndarray:
    x = word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(bins)).astype(np.int64)


def _part_of(before: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Part of a hot word, seen so often, that its occurrences behind words of these bins go to."""
    return _bin_of(before, np.zeros(1, np.int64), 1 << 30) % (seen // PART + 1)


class _Numbers(dict):
    """Number of each word, in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


BLOCK_COLUMNS = ("block", "row", "doc_id", "held_out", "codes", "words")


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts as blocks: a row for each document, and one of the codes and the words."""
    block = TaskContext.get().partitionId() << 24
    numbers, codes, lengths, held, size = _Numbers(), [], [], [], 0

    def documents(ids: pa.Array, out: pa.Array) -> pa.RecordBatch:
        n = len(ids)
        columns = [
            pa.array([block] * n, pa.int64()),
            pa.array(range(len(lengths) - n, len(lengths)), pa.int64()),
            ids,
            out,
            pa.nulls(n, pa.binary()),
            pa.nulls(n, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=BLOCK_COLUMNS)

    def closed(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        code, length, out = np.concatenate(codes), np.array(lengths), np.array(held, bool)
        train = np.bincount(code[np.repeat(~out, length)], minlength=len(numbers))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        order = np.argsort(hashes)
        hashes, train = hashes[order], train[order]
        place = np.empty(len(order), np.int64)
        place[order[np.argsort(-train, kind="stable")]] = np.arange(len(order))
        columns = [
            pa.array([block], pa.int64()),
            pa.nulls(1, pa.int64()),
            pa.nulls(1, kind),
            pa.nulls(1, pa.bool_()),
            pa.array([pack(place[code], length, out.astype(np.int64))], pa.binary()),
            pa.array([pack(_steps(hashes), train)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=BLOCK_COLUMNS)

    for batch in batches:
        ids, out = batch["doc_id"], batch["held_out"]
        begin = 0
        for k, (text, is_held) in enumerate(zip(batch["text"].to_pylist(), out.to_pylist()), 1):
            words = tokens(text)
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            lengths.append(len(words))
            held.append(is_held is not False)  # learn only where it is known
            size += len(words)
            if size >= BLOCK:
                yield documents(ids.slice(begin, k - begin), out.slice(begin, k - begin))
                yield from closed(ids.type)
                block, begin, size = block + 1, k, 0
                numbers.clear(), codes.clear(), lengths.clear(), held.clear()
        if begin < len(ids):
            yield documents(ids.slice(begin), out.slice(begin))
    if codes:
        yield from closed(ids.type)


def _words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a block's words, and how often they are to learn from."""
    steps, train = unpack(data)
    return np.cumsum(steps.view(np.uint64), dtype=np.uint64), train


def _word_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of blocks by bin."""
    for batch in batches:
        for block, data in zip(batch["block"].to_pylist(), batch["words"].to_pylist()):
            hashes, train = _words_of(data)
            bins = (hashes >> np.uint64(56)).astype(np.int64)
            ends = np.searchsorted(bins, np.arange(WORD_BINS + 1)).tolist()
            found = [
                (k, block, COUNTS, pack(_steps(hashes[i:j]), train[i:j]))
                for k, (i, j) in enumerate(zip(ends[:-1], ends[1:]))
                if i < j
            ]
            yield from _rows(found).to_batches()


def _number(group: pa.Table) -> pa.Table:
    """Count the words of a bin; answer each block, in the order of its words."""
    key = group["key"][0].as_py()
    blocks, given = group["block"].to_pylist(), [_words_of(d) for d in group["data"].to_pylist()]
    words, at = np.unique(np.concatenate([h for h, _ in given]), return_inverse=True)
    train = np.concatenate([t for _, t in given])
    count = np.bincount(at, weights=train, minlength=len(words)).astype(np.int64)
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, -count))] = np.arange(len(words))
    number = np.where(count >= LEAST, rank * WORD_BINS + key + 1, 0)
    out, begin = [], 0
    for block, (_, t) in zip(blocks, given):
        own = at[begin : begin + len(t)]
        begin += len(t)
        out.append((key, block, ANSWER, pack(number[own], count[own], t)))
    hot = count > HOT
    totals = np.array([count.sum(), (count > 0).sum()])
    out.append((key, -1, TOTALS, pack(totals, words[hot], number[hot], count[hot])))
    kept = count >= LEAST
    out.append((key, -1, COUNTS, pack(_steps(words[kept]), number[kept], count[kept])))
    return _rows(out)


class Root:
    """Chances under the empty context."""

    def __init__(self, tokens: int, words: int):
        self.tokens, self.words = tokens, words

    def chance(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(count))
        # The discounted counts leave one occurrence of each word.
        return np.maximum(count - 1, 0) / self.tokens + self.words / self.tokens / (self.words + 1)


def _triples(code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """(before or -1, middle, token, row) of the tokens that have a word before them."""
    start = np.zeros(len(code), bool)
    start[np.cumsum(length)[:-1]] = True
    start[0] = True
    row = np.repeat(np.arange(len(length), dtype=np.int32), length)
    before = np.empty(len(code) - 1, np.int32)
    before[:1], before[1:] = -1, code[:-2]
    before[start[:-1]] = -1
    at = ~start[1:]
    return before[at], code[:-1][at], code[1:][at], row[1:][at]


def _looked_up(group: pa.Table) -> tuple[np.ndarray, ...]:
    """(code, length, held) of a block's tokens and rows, (number, count, bin) of its codes."""
    rows = sorted(zip(group["kind"].to_pylist(), group["key"].to_pylist(), group["data"].to_pylist()))
    answers = [(k, *unpack(d)) for _, k, d in rows[1:]]
    bin_ = np.repeat([a[0] for a in answers], [len(a[1]) for a in answers])
    number, count, train = (np.concatenate([a[k] for a in answers]) for k in (1, 2, 3))
    order = np.argsort(-train, kind="stable")
    code, length, held = unpack(rows[0][2])
    return code.astype(np.int32), length, held, number[order], count[order], bin_[order]


def _occurrences(root: Root, bins: int):
    """The occurrences of a block's middle words by bin, and each row's sums under the root."""

    def run(group: pa.Table) -> pa.Table:
        block = group["block"][0].as_py()
        code, length, held, number, count, word_bin = _looked_up(group)
        ends = np.cumsum(length) - length
        base = np.add.reduceat((np.log10(count + 1) - np.log10(root.tokens + root.words + 1))[code], ends)
        score = np.add.reduceat(np.log(root.chance(count))[code], ends)
        known = np.add.reduceat((count > 0).astype(np.int64)[code], ends)
        found = [(block % bins, block, BASE, pack(length, known, base, score))]
        before, middle, token, row = _triples(code, length)
        good = number[middle] > 0
        before, middle, token, row = before[good], middle[good], token[good], row[good]
        if not len(row):
            return _rows(found)
        # Places among the numbered words of the block, 0 for others.
        local = np.unique(number)
        local = local[local > 0]
        place = np.where(number > 0, np.searchsorted(local, number) + 1, 0).astype(np.int32)
        a = np.where(before >= 0, place[before], 0)
        b, c = place[middle], place[token]
        del code, middle, token, good
        local = np.concatenate([[0], local])
        counts = np.zeros(len(local), np.int64)
        counts[place] = np.where(place > 0, count, 0)
        whole = _bin_of(local, np.zeros(1, np.int64), bins).astype(np.int32)
        bin_ = whole[b]
        often = np.nonzero((counts > HOT)[b])[0]
        if len(often):
            before = np.where(before[often] >= 0, word_bin[before[often]], WORD_BINS)
            bin_[often] = _bin_of(local[b[often]], _part_of(before, counts[b[often]]), bins)
        turns = 1 + len(row) // SORTED
        for turn in range(turns):
            own = np.nonzero(bin_ % turns == turn)[0]
            tag = row[own] * np.int64(2) + held[row[own]]
            found += _sorted_bins(block, local, counts, bin_[own], a[own], b[own], c[own], tag)
        return _rows(found)

    return run


def _sorted_bins(block, local, counts, bin_, a, b, c, tag) -> list[tuple[int, int, int, bytes]]:
    """The packed triples of some bins: words, counts, distinct triples in order, their rows."""
    if len(local) < 1 << 21:
        order = np.lexsort(((b.astype(np.int64) * len(local) + a) * len(local) + c, bin_))
    else:
        order = np.lexsort((c, a, b, bin_))
    a, b, c, bin_, tag = a[order], b[order], c[order], bin_[order], tag[order]
    bins = _runs(bin_)
    found = []
    for i, j in zip(bins.tolist(), [*bins[1:].tolist(), len(bin_)]):
        s = slice(i, j)
        first = _runs(b[s], a[s], c[s])
        x, y, z = b[s][first], a[s][first], c[s][first]
        own = np.unique(np.concatenate([x, y, z]))
        x, y, z = (np.searchsorted(own, v) for v in (x, y, z))
        sizes = np.diff(first, append=j - i)
        # A context's words before go up within their middle word.
        up = _steps(y)
        new = _runs(x)
        up[new] = y[new]
        data = pack(_steps(local[own]), counts[own], _steps(x), up, z, sizes, tag[s])
        found.append((int(bin_[i]), block, TRIPLES, data))
    return found


def _running(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running sums that begin again at each place of ``new``."""
    total = np.cumsum(steps)
    return total - np.repeat((total - steps)[new], np.diff(new, append=len(steps)))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of wanted in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _gain(n: np.ndarray, size: np.ndarray, rest: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """What a kept follower adds to the gain of its context, each occurrence left out of its own
    estimate."""
    others = np.maximum(size - 1, 1)
    chance = np.maximum(n - 2, 0) / others + np.maximum(rest, 1) / others * parent
    return n * np.log(chance / parent)


def _weight(size: np.ndarray, kept: np.ndarray, seen: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Weight that retained contexts leave to their suffix; NaN for others."""
    rest = size - kept
    lone = np.maximum(rest - 1, 0.5) / np.maximum(size - 1, 1)
    good = (seen > 0) & (rest > 0) & (gain + (size - seen) * np.log(lone) > GAIN * size)
    return np.where(good, rest / np.maximum(size, 1), np.nan)


def _states(at: np.ndarray, n: np.ndarray, parent: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Weights of contexts of these sizes, from the kept followers ``n`` of the contexts ``at``."""
    kept = np.bincount(at, weights=n - 1, minlength=len(size))
    seen = np.bincount(at, weights=n, minlength=len(size))
    gain = _gain(n, size[at], (size - kept)[at], parent)
    return _weight(size, kept, seen, np.bincount(at, weights=gain, minlength=len(size)))


@dataclass(frozen=True)
class Hot:
    """The hot words in the order of their numbers, and their weights if they are retained."""

    hash: np.ndarray
    number: np.ndarray
    size: np.ndarray
    weight: np.ndarray


def _judge(root: Root, hot: Hot):
    """Sums by block and row of what the contexts of a bin add to log chances."""

    def run(blobs: list[tuple[int, bytes]], given: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        # First reading: the distinct triples of each blob and how often they are to learn from.
        words = [unpack(d, 0, 1) for _, d in blobs]
        words = [(np.cumsum(steps), count) for steps, count in words]
        word, first = np.unique(np.concatenate([w for w, _ in words]), return_index=True)
        count = np.concatenate([c for _, c in words])[first]
        m = len(word)
        pairs, followers, learned = [], [], []
        for (own, _), (_, d) in zip(words, blobs):
            x, up, z, sizes, tag = unpack(d, 2, 3, 4, 5, 6)
            x = np.cumsum(x)
            y = _running(up, _runs(x))
            place = np.searchsorted(word, own)
            pairs.append(place[x] * m + place[y])
            followers.append(place[z].astype(np.int32))
            learned.append(np.add.reduceat(1 - (tag & 1), np.cumsum(sizes) - sizes).astype(np.int32))
        blob_ends = np.cumsum([len(x) for x in learned])
        pair, at_pair = np.unique(np.concatenate(pairs), return_inverse=True)
        pairs.clear()
        triple, at = np.unique(at_pair * m + np.concatenate(followers), return_inverse=True)
        del at_pair, followers
        at = at.astype(np.int32)
        n3 = np.bincount(at, weights=np.concatenate(learned), minlength=len(triple))
        context, c = (triple // m).astype(np.int32), (triple % m).astype(np.int32)
        del triple, learned
        pair_b, known_a = (pair // m).astype(np.int32), word[pair % m] > 0
        b = pair_b[context]
        # Pairs of the middle word and the token, and the state of the middle word.
        gram, of = np.unique(b.astype(np.int64) * m + c, return_inverse=True)
        of = of.astype(np.int32)
        n2 = np.bincount(of, weights=n3, minlength=len(gram))
        gram_b, gram_c = gram // m, gram % m
        size_b = np.bincount(b, weights=n3, minlength=m)
        del b, c
        hot_at, is_hot = _at(hot.number, word)
        if is_hot.any():
            n2[is_hot[gram_b]] = 0
            for steps, token, n in map(unpack, given):
                wanted = np.searchsorted(word, np.cumsum(steps)) * m + np.searchsorted(word, token)
                place, seen = _at(gram, wanted)
                n2[place[seen]] = n[seen]
            size_b[is_hot] = hot.size[hot_at[is_hot]]
        kept = (n2 >= LEAST) & (word[gram_c] > 0)
        parent = root.chance(count[gram_c])
        weight_b = _states(gram_b[kept], n2[kept], parent[kept], size_b)
        if is_hot.any():
            weight_b[is_hot] = hot.weight[hot_at[is_hot]]
        retained = ~np.isnan(weight_b)
        own = weight_b[gram_b]
        size = np.maximum(size_b, 1)[gram_b]
        backed = np.where(retained[gram_b], own, 1.0) * parent
        chance = backed + np.where(kept & retained[gram_b], (n2 - 1) / size, 0.0)
        # Triples, and the state of each pair of words: its suffix must be retained too.
        kept3 = (n3 >= LEAST) & kept[of] & known_a[context]
        size_ab = np.bincount(context, weights=n3, minlength=len(pair))
        weight_ab = _states(context[kept3], n3[kept3], chance[of[kept3]], size_ab)
        state = ~np.isnan(weight_ab) & retained[pair_b] & known_a
        in_state = state[context]
        last = np.where(in_state, weight_ab[context], 1.0) * chance[of]
        last += np.where(in_state & kept3, (n3 - 1) / np.maximum(size_ab, 1)[context], 0.0)
        value = np.log(last / parent[of])
        del of, last, in_state, kept3, context, n3
        # Second reading: the rows.
        begin = 0
        for (block, d), end in zip(blobs, blob_ends.tolist()):
            sizes, tag = unpack(d, 5, 6)
            each = np.repeat(value[at[begin:end]], sizes)
            begin = end
            sums = np.bincount(tag >> 1, weights=each)
            rows = np.nonzero(sums)[0]
            yield block, rows, sums[rows]

    return run


def _judge_bins(root: Root, hot: Hot):
    """One row of sums for each block that a task meets, over its bins, which come in order."""
    judge = _judge(root, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def emit() -> list[pa.RecordBatch]:
            out = []
            for block, sums in held.items():
                rows = np.nonzero(sums)[0]
                out.append((0, block, SUMS, pack(_steps(rows), sums[rows])))
            held.clear()
            return _rows(out).to_batches()

        rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in SCHEMA.names)))
        for _, own in itertools.groupby(rows, lambda row: row[0]):
            found = {BASE: [], TRIPLES: [], PAIRS: []}
            for row in own:
                found[row[2]].append(row)
            yield from _rows(found[BASE]).to_batches()
            if not found[TRIPLES]:
                continue
            for block, at, value in judge([(b, d) for _, b, _, d in found[TRIPLES]], [d for _, _, _, d in found[PAIRS]]):
                most = int(at[-1]) + 1 if len(at) else 0
                sums = held.get(block, np.zeros(0))
                if len(sums) < most:
                    size += most - len(sums)
                    sums = np.concatenate([sums, np.zeros(most - len(sums))])
                sums[at] += value
                held[block] = sums
            if size > BLOCK:
                yield from emit()
                size = 0
        yield from emit()

    return run


SUMMED = "block long, row long, n_tokens long, n_known long, base_score double, score double"


def _add_up(group: pa.Table) -> pa.Table:
    """The sums of a block's rows."""
    block = group["block"][0].as_py()
    rows = sorted(zip(group["kind"].to_pylist(), group["data"].to_pylist()))
    length, known, base, score = unpack(rows[0][1])
    score = score.copy()
    for _, d in rows[1:]:
        at, value = unpack(d)
        score[np.cumsum(at)] += value
    n = len(length)
    columns = [np.full(n, block), np.arange(n), length, known, base, score / LN10]
    return pa.table(columns, names=["block", "row", "n_tokens", "n_known", "base_score", "score"])


def _hot_pairs(hot: Hot):
    """Of each block, how often hot words (by place) have which follower (by hash) in which part,
    by the bin of the follower."""
    by_hash = np.argsort(hot.hash)

    def pairs(block: int, codes: bytes, words: bytes) -> list[tuple[int, int, int, bytes]]:
        code, length, held = unpack(codes)
        hashes, train = _words_of(words)
        hashes = hashes[np.argsort(-train, kind="stable")]
        at, is_hot = _at(hot.hash[by_hash], hashes)
        before, middle, token, row = _triples(code.astype(np.int32), length)
        use = is_hot[middle]
        before, middle, token, row = before[use], middle[use], token[use], row[use]
        if not len(row):
            return []
        bins = (hashes >> np.uint64(56)).astype(np.int64)
        b = by_hash[at[middle]]
        part = _part_of(np.where(before >= 0, bins[before], WORD_BINS), hot.size[b])
        rank = np.empty(len(hashes), np.int64)
        rank[np.argsort(hashes)] = np.arange(len(hashes))
        order = np.lexsort((part, rank[token], b, bins[token]))
        b, part, token, n = b[order], part[order], token[order], 1 - held[row[order]]
        first = _runs(bins[token], b, token, part)
        n = np.add.reduceat(n, first)
        b, part, c, to = b[first], part[first], hashes[token[first]], bins[token[first]]
        ends = _runs(to)
        return [
            (int(to[i]), block, PAIRS, pack(b[i:j], _steps(c[i:j]), part[i:j], n[i:j]))
            for i, j in zip(ends.tolist(), [*ends[1:].tolist(), len(to)])
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in zip(*(batch[c].to_pylist() for c in ("block", "codes", "words"))):
                yield from _rows(pairs(*found)).to_batches()

    return run


def _merge_pairs(group: pa.Table) -> pa.Table:
    """The kept pairs of a bin of followers, and the parts that hold them."""
    key = group["key"][0].as_py()
    rows = list(zip(group["kind"].to_pylist(), group["data"].to_pylist()))
    given = [unpack(d) for kind, d in rows if kind == PAIRS]
    if not given:
        return _rows([])
    steps, number, count = next(unpack(d) for kind, d in rows if kind == COUNTS)
    b, part, n = (np.concatenate([x[k] for x in given]) for k in (0, 2, 3))
    c = np.concatenate([np.cumsum(x[1].view(np.uint64), dtype=np.uint64) for x in given])
    at, known = _at(np.cumsum(steps.view(np.uint64), dtype=np.uint64), c)
    b, part, n, at = b[known], part[known], n[known], at[known]
    if not len(b):
        return _rows([])
    order = np.lexsort((part, at, b))
    b, part, n, at = b[order], part[order], n[order], at[order]
    first = _runs(b, at)
    total = np.add.reduceat(n, first)
    each = np.repeat(total, np.diff(first, append=len(b)))
    to = _runs(b, at, part)
    to = to[each[to] >= LEAST]
    kept = total >= LEAST
    first = first[kept]
    data = pack(b[first], count[at[first]], total[kept], b[to], number[at[to]], part[to], each[to])
    return _rows([(key, -1, PAIRS, data)])


def _hot_sums(root: Root, size: np.ndarray, kept: np.ndarray | None):
    """Sums over kept pairs of hot words: (c - 1, c), or the gains if the first are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(size)))
        for batch in batches:
            for d in batch["data"].to_pylist():
                b, seen, n = unpack(d, 0, 1, 2)
                if kept is None:
                    values = (n - 1, n)
                else:
                    gain = _gain(n, size[b], (size - kept)[b], root.chance(seen))
                    values = (gain, np.zeros(len(n)))
                for k, v in enumerate(values):
                    sums[k] += np.bincount(b, weights=v, minlength=len(size))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(size))), pa.array(sums[0]), pa.array(sums[1])], names=["word", "x", "y"]
        )

    return run


def _pairs_to(word: np.ndarray, bins: int):
    """The kept pairs of hot words to the bins of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch["data"].to_pylist():
                b, c, part, n = unpack(d, 3, 4, 5, 6)
                to = _bin_of(word[b], part, bins)
                found = []
                for k in np.unique(to).tolist():
                    s = np.nonzero(to == k)[0]
                    s = s[np.lexsort((c[s], word[b[s]]))]
                    found.append((k, -1, PAIRS, pack(_steps(word[b[s]]), c[s], n[s])))
                if found:
                    yield from _rows(found).to_batches()

    return run


def _hot_states(root: Root, blocks: DataFrame, counts: DataFrame, hot: Hot) -> tuple[DataFrame, Hot]:
    """The pairs of hot words, and the words with their weights."""
    found = blocks.mapInArrow(_hot_pairs(hot), PACKED).union(counts)
    pairs = written(found.groupBy("key").applyInArrow(_merge_pairs, PACKED), "hot-pairs")

    def summed(kept: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        sums = pairs.select("data").mapInArrow(_hot_sums(root, hot.size, kept), "word long, x double, y double")
        rows = sums.groupBy("word").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()
        out = np.zeros((2, len(hot.size)))
        for r in rows:
            out[:, r["word"]] = r["x"], r["y"]
        return out[0], out[1]

    kept, seen = summed(None)
    return pairs, replace(hot, weight=_weight(hot.size, kept, seen, summed(kept)[0]))


def scores(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = docs.select(
        column(docs, key).alias("doc_id"),
        held.alias("held_out"),
        text_of(docs, text).cast("binary").alias("text"),
    )
    kinds = (T.LongType(), T.LongType(), rows.schema["doc_id"].dataType, T.BooleanType(), T.BinaryType(), T.BinaryType())
    schema = T.StructType([T.StructField(n, kind) for n, kind in zip(BLOCK_COLUMNS, kinds)])
    # Written once: the rows' places are then fixed, whatever is lost later.
    read = written(rows.mapInArrow(_read_blocks, schema), "blocks")
    blocks = read.filter(F.col("codes").isNotNull()).select("block", "codes", "words")
    words = blocks.select("block", "words").mapInArrow(_word_bins, PACKED)
    answers = written(words.groupBy("key").applyInArrow(_number, PACKED), "answers")
    totals = [unpack(r["data"]) for r in answers.filter(F.col("kind") == TOTALS).select("data").collect()]
    root = Root(*(sum(int(x[0][k]) for x in totals) for k in (0, 1)))
    hashes, number, size = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in totals)]) for k in (1, 2, 3))
    order = np.argsort(number)
    hot = Hot(hashes[order].view(np.uint64), number[order], size[order], np.zeros(0))
    n = root.tokens
    bins = max(min(1 + n // BIN, 96), 1 + n // (8 * BIN))
    coded = blocks.select(
        F.lit(0).cast("long").alias("key"), "block", F.lit(CODES).alias("kind"), F.col("codes").alias("data")
    )
    looked_up = coded.union(answers.filter(F.col("kind") == ANSWER))
    sent = looked_up.groupBy("block").applyInArrow(_occurrences(root, bins), PACKED)
    if len(hot.number):
        pairs, hot = _hot_states(root, blocks, answers.filter(F.col("kind") == COUNTS), hot)
        sent = sent.union(pairs.select("data").mapInArrow(_pairs_to(hot.number, bins), PACKED))
    judged = sent.repartition("key").sortWithinPartitions("key").mapInArrow(_judge_bins(root, hot), PACKED)
    sums = judged.groupBy("block").applyInArrow(_add_up, SUMMED)
    documents = read.filter(F.col("row").isNotNull()).select("block", "row", "doc_id", "held_out")
    return documents.join(sums, ["block", "row"]).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
