"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of the last 0 to ``DEPTH`` tokens. The next-token distribution of a context s
seen N(s) times is smoothed towards that of its suffix s': a token w that followed c times has

    P(w | s) = (c - 1) / N(s) + T(s) / N(s) * P(w | s'),   T(s) = N(s) - sum (c - 1),

so a follower seen once gives all its weight to the shorter context, and only followers seen
twice or more are kept. The empty context has (c - 1) / N for a word and shares the rest evenly
over the V known words and one unknown word.

A context is a candidate, and a follower is kept, if seen ``LEAST`` times, however large the
corpus is. A candidate is retained by a divergence test: the weighted log-ratio of its
distribution to that of its suffix, with each occurrence left out of its own estimate, must
exceed ``GAIN`` nats an occurrence; a child keeps its suffix retained. Scoring walks the tokens
with the longest retained suffix as the state.

``scores`` (``suffix_scores.py``) scores texts, counting by middle word and writing no tree out.
``learn`` gives the tree itself. Its grams, states and chances are written tables; the test groups
on the context key. A gram is known by the pair of its left and right part (words for two words,
two-word grams for three), and its key is a hash of the two. Filters of fixed size leave out keys
that cannot be in a table before the shuffle; what they let through is decided by the count or the
join. Of the tree, the part seen in at least ``1 / RESOLUTION`` of the training tokens comes back,
at most ``RESOLUTION`` entries a depth.

Defined cases: a NULL or empty text has the one end token; with nothing to learn from, N and V
are zero and every token is unknown; texts of any length are read whole; repeated rows count as
often as they stand; NULL keys count as one key '' for the split; an empty table gives an empty
one. Other columns are not read, whatever their names. Words are compared by a 64-bit hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import text_of
from tidelake.llm.suffix_scores import END, GAIN, LEAST, scores, tokens
from tidelake.llm.suffix_scores import word_hash as _hash
from tidelake.session import written

__all__ = ["END", "Places", "Tree", "learn", "scores", "tokens"]

DEPTH = 2  # words of the longest context
RESOLUTION = 1 << 19  # entries a depth of the cache
FILTER_BITS = 27
BITS = 20  # of a word's place in a key of up to three words
FLUSH = 1 << 20


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def emit() -> pa.RecordBatch:
        words = list(counts)
        out = pa.record_batch(
            {"word": pa.array(list(map(_hash, words)), pa.int64()),
             "n": pa.array(list(counts.values()), pa.int64())}
        )
        counts.clear()
        return out

    for batch in batches:
        for text in batch["text"].to_pylist():
            counts.update(tokens(text))
            if len(counts) >= FLUSH:
                yield emit()
    yield emit()


class Places:
    """Place of each frequent word in the head, and -1 for others; remembered by word."""

    def __init__(self, head: np.ndarray):
        self.head = head  # sorted hashes
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        missing = [w for w in set(words) if w not in known]
        if missing:
            if len(known) > FLUSH:
                known.clear()
                missing = list(set(words))
            hashes = np.array(list(map(_hash, missing)), dtype=np.int64)
            at = np.searchsorted(self.head, hashes)
            at = np.minimum(at, max(0, len(self.head) - 1))
            hit = self.head[at] == hashes if len(self.head) else np.zeros(len(hashes), bool)
            known.update(zip(missing, np.where(hit, at, -1).tolist()))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of wanted in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Hashes:
    """Hash of each word; remembered by word."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > FLUSH:
            known.clear()
        for w in set(words).difference(known):
            known[w] = _hash(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def mix(left: np.ndarray, right: np.ndarray | int) -> np.ndarray:
    """Key of the gram with these parts."""
    key = left.astype(np.int64).view(np.uint64)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    key = key + (right.astype(np.int64).view(np.uint64) if isinstance(right, np.ndarray) else np.uint64(right))
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


@F.arrow_udf(T.LongType())
def _key_of(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(mix(left.to_numpy(zero_copy_only=False), right.to_numpy(zero_copy_only=False)))


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Filter of the column ``key``: at most 2 ** (FILTER_BITS - 6) words reach the driver."""
    high = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    low = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    at = keys.select(F.explode(F.array(high, low)).alias("p"))
    words = at.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")
    )
    w, bits = _arrays(words, "w", "bits")
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[w] = bits
    return out.view(np.uint64)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hashes = keys.view(np.uint64)
    hit = np.ones(len(keys), bool)
    for p in (hashes >> np.uint64(64 - FILTER_BITS), hashes & np.uint64((1 << FILTER_BITS) - 1)):
        word = bits[(p >> np.uint64(6)).view(np.int64)]
        hit &= (word >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def _count_grams(depth: int, bits: np.ndarray):
    """Counts of the grams of ``depth`` + 1 words whose two parts pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lefts, rights, held = Hashes(), [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            left = np.concatenate([np.empty(0, np.int64), *lefts])
            right = np.concatenate([np.empty(0, np.int64), *rights])
            lefts.clear(), rights.clear()
            _, at, n = np.unique(mix(left, right), return_index=True, return_counts=True)
            out = pa.record_batch(
                {"left": pa.array(left[at]), "right": pa.array(right[at]), "n": pa.array(n, pa.int64())}
            )
            for k in range(0, out.num_rows, FLUSH // 8):
                yield out.slice(k, FLUSH // 8)

        for batch in batches:
            for text in batch["text"].to_pylist():
                parts = hashes.of(tokens(text))
                for _ in range(depth - 1):
                    parts = mix(parts[:-1], parts[1:])
                good = _passes(bits, parts)
                at = np.nonzero(good[:-1] & good[1:])[0]
                lefts.append(parts[at])
                rights.append(parts[at + 1])
                held += len(at)
                if held >= 2 * FLUSH:
                    yield from emit()
                    held = 0
        yield from emit()

    return run


@dataclass(frozen=True)
class Tree:
    """Counts of the root, the head words, and for each depth the states and their followers."""

    tokens: int
    words: int
    discounted: int  # sum of c - 1 over all words
    head: np.ndarray
    head_count: np.ndarray
    states: list[tuple[np.ndarray, np.ndarray]]  # context keys, log of the backed-off weight
    followers: list[tuple[np.ndarray, np.ndarray]]  # gram keys, (c - 1) / N of the context

    def root(self, count: np.ndarray) -> np.ndarray:
        """Probability of a word with this training count under the empty context."""
        rest = (self.tokens - self.discounted) / max(1, self.tokens) / (self.words + 1)
        if not self.tokens:
            return np.ones(len(count))
        return np.maximum(count - 1, 0) / self.tokens + rest


def _root_column(tree: Tree, count: Column) -> Column:
    if not tree.tokens:
        return F.lit(1.0)
    rest = (tree.tokens - tree.discounted) / tree.tokens / (tree.words + 1)
    return F.greatest(count - 1, F.lit(0)) / F.lit(float(tree.tokens)) + F.lit(rest)


def _log_chances(tree: Tree, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: (log probability under its state, log weight left to the root).

    The first is NaN for a tail word, whose probability is the root's times the weight.
    """
    n = len(places)
    head = places >= 0
    chance = np.full(n, np.nan)
    if len(tree.head):
        chance[head] = tree.root(tree.head_count[places[head]])
    left = np.zeros(n)
    for depth, (keys, log_rest) in enumerate(tree.states, 1):
        if not len(keys) or n <= depth:
            continue
        context = np.zeros(n - depth, np.int64)
        good = np.ones(n - depth, bool)
        for k in range(depth):
            part = places[k : k + n - depth]
            good &= part >= 0
            context = context << BITS | np.maximum(part, 0)
        at, found = _find(keys, context)
        found &= good
        end = np.nonzero(found)[0] + depth
        if not len(end):
            continue
        rest = log_rest[at[found]]
        left[end] += rest
        gram = context[found] << BITS | np.maximum(places[end], 0)
        grams, extra = tree.followers[depth - 1]
        place, seen = _find(grams, gram)
        seen &= places[end] >= 0
        own = np.zeros(len(end))
        own[seen] = extra[place[seen]]
        chance[end] = chance[end] * np.exp(rest) + own
    return np.log(chance), left


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table[name].to_numpy() for name in names]


def learn(rows: DataFrame, text: str = "text") -> tuple[Tree, DataFrame]:
    """The cached tree of all rows, and the table (word, count) of all training words."""
    rows = rows.select(text_of(rows, text).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count_words, "word long, n long")
    counts = written(counted.groupBy("word").agg(F.sum("n").alias("count")), "word-counts")
    sums = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.count("*").alias("words")
    ).collect()[0]
    total, n_words = int(sums["tokens"]), int(sums["words"])
    hot = max(LEAST, -(-total // RESOLUTION))
    head, head_count = _arrays(counts.filter(F.col("count") >= hot), "word", "count")
    order = np.argsort(head)
    head, head_count = head[order], head_count[order]
    tree = Tree(total, n_words, total - n_words, head, head_count, [], [])
    if not total:
        none = (np.empty(0, np.int64), np.empty(0))
        tree.states.extend([none] * DEPTH)
        tree.followers.extend([none] * DEPTH)
        return tree, counts
    shorter = counts.filter(F.col("count") >= LEAST).select(
        F.col("word").alias("key"), F.col("count").alias("n"),
        _root_column(tree, F.col("count")).alias("chance"),
    )
    states, hot_grams = None, None
    for depth in range(1, DEPTH + 1):
        found = rows.mapInArrow(
            _count_grams(depth, _filter_of(shorter)), "left long, right long, n long"
        )
        found = found.groupBy("left", "right").agg(F.sum("n").alias("n"))
        found = found.filter(F.col("n") >= LEAST)
        longer = written(found.withColumn("key", _key_of("left", "right")), "grams")
        tests = written(_tests(longer, shorter), "contexts")
        judged = written(_judged(longer, shorter, tests), "judged")
        states = written(_retained(judged, tests, states, shorter, depth), "states")
        grams = written(_chances(judged, states), "chances")
        hot_grams = _cache(tree, depth, hot, states, grams, hot_grams)
        shorter = grams.select("key", "left", "right", "n", "chance")
    return tree, counts


def _tests(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """Of each context: its size, the weight given to the suffix, occurrences of lone followers."""
    sums = longer.groupBy(F.col("left").alias("key")).agg(
        F.sum(F.col("n") - 1).alias("kept"), F.sum("n").alias("seen")
    )
    own = shorter.select("key", F.col("n").alias("size"))
    return sums.join(own, "key").select(
        "key", "size", (F.col("size") - F.col("kept")).alias("rest"),
        (F.col("size") - F.col("seen")).alias("single"),
    )


def _judged(longer: DataFrame, shorter: DataFrame, tests: DataFrame) -> DataFrame:
    """Grams with the chance under the suffix and what they add to their context's gain."""
    parents = shorter.select(F.col("key").alias("right"), F.col("chance").alias("parent"))
    context = tests.withColumnRenamed("key", "left")
    # Each occurrence of a follower seen c times finds the other c - 1 among the other N - 1.
    others = F.greatest(F.col("size") - 1, F.lit(1))
    chance = (
        F.greatest(F.col("n") - 2, F.lit(0)) / others
        + F.greatest(F.col("rest"), F.lit(1)) / others * F.col("parent")
    )
    gain = F.col("n") * F.log(chance / F.col("parent"))
    joined = longer.join(parents, "right").join(context, "left")
    return joined.select("key", "left", "right", "n", "parent", gain.alias("gain"))


def _retained(judged: DataFrame, tests: DataFrame, states: DataFrame | None, shorter: DataFrame,
              depth: int) -> DataFrame:
    """(key, first, last, size, weight) of the contexts that pass the test."""
    gains = judged.groupBy(F.col("left").alias("key")).agg(F.sum("gain").alias("gain"))
    lone = F.greatest(F.col("rest") - 1, F.lit(0.5)) / F.greatest(F.col("size") - 1, F.lit(1))
    gain = F.col("gain") + F.col("single") * F.log(lone)
    good = tests.join(gains, "key").filter((gain > GAIN * F.col("size")) & (F.col("rest") > 0))
    good = good.select("key", "size", (F.col("rest") / F.col("size")).alias("weight"))
    if depth == 1:
        return good.select("key", F.col("key").alias("first"), F.col("key").alias("last"), "size", "weight")
    parts = shorter.select("key", F.col("left").alias("first"), F.col("right").alias("last"))
    suffixes = states.select(F.col("key").alias("last"))
    return good.join(parts, "key").join(suffixes, "last", "left_semi").select(
        "key", "first", "last", "size", "weight"
    )


def _chances(judged: DataFrame, states: DataFrame) -> DataFrame:
    """Grams with their chance; weight and size are those of a retained context, else NULL."""
    own = states.select(F.col("key").alias("left"), "size", "weight")
    chance = (F.col("n") - 1) / F.col("size") + F.col("weight") * F.col("parent")
    return judged.join(own, "left", "left").select(
        "key", "left", "right", "n", "parent", "size", "weight",
        F.coalesce(chance, F.col("parent")).alias("chance"),
    )


def _cache(tree: Tree, depth: int, hot: int, states: DataFrame, grams: DataFrame, pairs):
    """Add the states and followers seen ``hot`` times; returns the frequent pairs of words."""
    key, left, right, n, size = _arrays(
        grams.filter(F.col("n") >= hot).select("key", "left", "right", "n", F.coalesce("size", F.lit(0)).alias("size")),
        "key", "left", "right", "n", "size",
    )
    first, last, seen, weight = _arrays(
        states.filter(F.col("size") >= hot), "first", "last", "size", "weight"
    )

    def place(words: np.ndarray) -> np.ndarray:
        return _find(tree.head, words)[0]

    if depth == 1:
        state, gram = place(first), place(left) << BITS | place(right)
        order = np.argsort(key)
        pairs = key[order], gram[order]
    else:
        state = place(first) << BITS | place(last)
        before, after = (pairs[1][_find(pairs[0], part)[0]] for part in (left, right))
        gram = before << BITS | after & ((1 << BITS) - 1)
    order = np.argsort(state)
    tree.states.append((state[order], np.log(weight[order])))
    use = np.nonzero(size > 0)[0]
    use = use[np.argsort(gram[use])]
    tree.followers.append((gram[use], (n[use] - 1) / size[use]))
    return pairs
