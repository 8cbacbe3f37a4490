"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit a binary classifier on character n-grams
(lengths 2 and 3, hashed to ``BUCKETS``) predicts it: a multinomial model whose two classes are
the languages with the bit set and the others, each language with equal weight; its margin is
the mean log-odds of a text's n-grams. Decoding is loss-weighted: the logistic loss of each
margin against the codeword is weighted by how well that classifier does on that language in
training, and the codeword with the smallest loss wins. The score is its share in the softmin of
all losses; texts whose two best shares differ by less than ``MARGIN`` are flagged as ambiguous.

Counts are taken over all training rows, by partition and then by key. A language is learned if
its training rows hold ``LEAST_GRAMS`` n-grams, whatever share of the corpus that is; the model
has ``BUCKETS`` numbers for each bit, and the bits grow with the logarithm of the languages.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0, also in training,
where it is left out; with nothing learned every text is ``und``; with one language every text
with a letter is that one; ties go to the smaller language name; texts are read whole; repeated
rows count as often as they stand; an empty table gives an empty one; other columns pass through,
but one that is named like the result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import column, text_of
from tidelake.session import written

BUCKETS = 1 << 14
LEAST_GRAMS = 400  # of about 200 characters
HELD_LANGUAGES = 128  # whose counts a task holds before it gives them on
EXHAUSTIVE = 6
SMOOTHING = 0.5
SCALE = 6.0
SHARPNESS = 8.0
MARGIN = 0.2
CHUNK = 1 << 16
UNDEFINED = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits, rows sum to 1


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, a blank for all else."""
    table = np.full(0x10000, 32, np.uint32)
    for i in range(0x10000):
        char = chr(i)
        if char.isalpha():
            low = char.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text; empty if it has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = np.where(
        points < 0x10000, _letters()[np.minimum(points, 0xFFFF)], np.where(points < 0x20000, 32, points)
    ).astype(np.uint32)
    if not (letters != 32).any():
        if not any(c.isalpha() for c in text):
            return np.empty(0, np.int64)
        letters = points
    padded = np.concatenate(([32], letters, [32])).astype(np.uint64)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    padded = padded[keep]
    two = padded[:-1] * np.uint64(0x100000001B3) ^ padded[1:] * np.uint64(0x9E3779B97F4A7C15)
    three = two[:-1] * np.uint64(31) ^ padded[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate((two, three))
    both *= np.uint64(0xFF51AFD7ED558CCD)
    return (both >> np.uint64(64 - 14)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n languages; every bit splits the languages."""
    if n < 2:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        numbers = range(1, 1 << (n - 1))
        columns = [[1] + [1 if c >> k & 1 else -1 for k in range(n - 1)] for c in numbers]
        columns = [c for c in columns if -1 in c]
        return np.array([*columns, [1] + [-1] * (n - 1)], float).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best, best_gap = None, -1
    for _ in range(200):
        codes = rng.choice([-1.0, 1.0], size=(n, bits))
        codes[0, np.abs(codes.sum(axis=0)) == n] *= -1
        same = codes @ codes.T
        np.fill_diagonal(same, -bits)
        gap = int((bits - same.max()) // 2)
        if gap > best_gap:
            best, best_gap = codes, gap
    return best


def margins(model: Model, found: np.ndarray) -> np.ndarray:
    """Mean log-odds of each bit."""
    total = np.zeros(model.weights.shape[1])
    for at in range(0, len(found), CHUNK):
        total += model.weights[found[at : at + CHUNK]].sum(axis=0)
    return total / max(1, len(found))


def decode(model: Model, found: np.ndarray) -> tuple[str, float, bool]:
    """(language, score, ambiguous) of the n-grams of a text."""
    if not len(found) or not model.languages:
        return UNDEFINED, 0.0, True
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    loss = np.logaddexp(0, -SCALE * model.codes * margins(model, found))
    total = (model.trust * loss).sum(axis=1)
    share = np.exp(-SHARPNESS * (total - total.min()))
    share /= share.sum()
    order = np.lexsort((np.arange(len(share)), -share))
    first, second = share[order[0]], share[order[1]]
    return model.languages[order[0]], float(first), bool(first - second < MARGIN)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts by language of a partition; bucket -1 counts the rows."""
    sums: dict[str, np.ndarray] = {}

    def emit():
        for name, counts in sums.items():
            at = np.nonzero(counts)[0]
            yield pa.record_batch(
                {"lang": pa.array([name] * len(at)), "bucket": pa.array(at - 1, pa.int32()),
                 "n": pa.array(counts[at])}
            )
        sums.clear()

    for batch in batches:
        for name, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            found = grams(text)
            if len(found):
                if name not in sums:
                    if len(sums) >= HELD_LANGUAGES:
                        yield from emit()
                    sums[name] = np.zeros(BUCKETS + 1, np.int64)
                sums[name][1:] += np.bincount(found, minlength=BUCKETS)
                sums[name][0] += 1
    yield from emit()


def _hits(model: Model):
    """Rows and right bits of each language in a partition; bit -1 counts the rows."""
    place = {name: i for i, name in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bits = model.codes.shape
        sums = np.zeros((n, bits + 1), np.int64)
        for batch in batches:
            for name, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                at, found = place.get(name), grams(text)
                if at is not None and len(found):
                    sums[at, 0] += 1
                    sums[at, 1:] += margins(model, found) * model.codes[at] > 0
        lang, bit = np.nonzero(sums)
        yield pa.record_batch(
            {"lang": pa.array(lang, pa.int32()), "bit": pa.array(bit - 1, pa.int32()),
             "n": pa.array(sums[lang, bit])}
        )

    return run


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with a language."""
    rows = rows.select(
        column(rows, lang).cast("string").alias("lang"), text_of(rows, text).alias("text")
    ).filter(F.col("lang").isNotNull())
    counted = rows.mapInArrow(_count, "lang string, bucket int, n long")
    counted = written(
        counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-grams"
    )
    sizes = counted.filter("bucket >= 0").groupBy("lang").agg(F.sum("n").alias("n"))
    kept = sizes.filter(F.col("n") >= LEAST_GRAMS).select("lang")
    languages = sorted(r["lang"] for r in kept.collect())
    table = counted.filter(F.col("lang").isin(languages) & (F.col("bucket") >= 0)).toArrow()
    place = {name: i for i, name in enumerate(languages)}
    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    at = np.array([place[x] for x in table["lang"].to_pylist()], dtype=np.int64)
    counts[at, table["bucket"].to_numpy()] += table["n"].to_numpy()
    shares = counts / counts.sum(axis=1, keepdims=True) if languages else counts
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        ones = codes[:, b] > 0
        weights[:, b] = np.log(shares[ones].mean(axis=0)) - np.log(shares[~ones].mean(axis=0))
    even = np.full(codes.shape, 1.0 / max(1, codes.shape[1]))
    model = Model(languages, codes, weights, even)
    if len(languages) < 2:
        return model
    hits = rows.mapInArrow(_hits(model), "lang int, bit int, n long")
    right = np.zeros((len(languages), codes.shape[1] + 1))
    for r in hits.groupBy("lang", "bit").agg(F.sum("n").alias("n")).collect():
        right[r["lang"], r["bit"] + 1] = r["n"]
    trust = (right[:, 1:] + 1) / (right[:, :1] + 2)
    return Model(languages, codes, weights, trust / trust.sum(axis=1, keepdims=True))


RESULT_TYPE = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
    ]
)
_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """All columns of ``docs`` and a struct of lang_pred, score and ambiguous."""

    @F.arrow_udf(RESULT_TYPE)
    def guess(texts: pa.Array) -> pa.Array:
        rows = [decode(model, grams(t)) for t in texts.to_pylist()]
        return pa.array([dict(zip(RESULT_TYPE.names, r)) for r in rows], type=_ARROW)

    return docs.withColumn(out, guess(text_of(docs, text)))
