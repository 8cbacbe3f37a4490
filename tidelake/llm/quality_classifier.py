"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; the unlabelled set is web text without a label, a mix of
both classes. A linear model on ``features`` of the text minimises the non-negative unbiased
risk: prior * loss on positives as 1, plus the loss of the unlabelled as 0 less prior * the loss
of the positives as 0, where the second part must not fall below zero (a step that would push it
there goes back instead). The prior, the share of positives among the unlabelled, is estimated
from a first classifier of positives against unlabelled: over sets of high scores, the smallest
ratio of the unlabelled's share to the positives' share.

Features are computed over all whole texts by Spark. The fit takes at most ``MAX_POSITIVES`` and
``MAX_UNLABELLED`` rows, those with the smallest hash of their id, and of them only the features.
If no row is unlabelled, all training rows stand for them.

Defined cases: NULL and empty texts have the features of no words and a score; without positives
or without rows to stand for the unlabelled every score is 0.5; a doc_id labelled more than once
counts by its largest label; texts of any length are read whole; repeated rows give repeated
results; NULL ids are never labelled; an empty table gives an empty one; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import column, text_of
from tidelake.session import written

MAX_POSITIVES = 20_000
MAX_UNLABELLED = 20_000
STEPS = 600
RATE = 0.05
DECAY = 1e-4
LEAST_SHARE = 0.2
LINE_WORDS = 8
CLIP = 6.0
HASH_RANGE = 1 << 30

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
MARKS = np.frombuffer(b".,;:?'\"()-", np.uint8)
NAMES = (
    "log_words", "word_length", "upper", "digit", "symbols", "pipes", "shouts", "distinct",
    "stutter", "top_word", "wide", "marks", "line_symbols", "line_upper", "line_stutter",
    "line_shouts", "line_pipes", "same_lines",
)


def _shares(data: bytes, words: list[bytes]) -> tuple[float, float, float, float, float]:
    """Symbols, pipes and shouts a word; upper case a byte; words equal to the one before."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(words)
    return (
        counts[SYMBOLS].sum() / n,
        counts[124] / n,
        counts[33] / n,
        counts[65:91].sum() / len(data),
        sum(map(eq, words, words[1:])) / n,
    )


def features_of(data: bytes) -> list[float]:
    """The features of one UTF-8 text."""
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    symbols, pipes, shouts, upper, stutter = _shares(data, words)
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    worst = np.zeros(5)
    lines = [line for line in data.split(b"\n") if line.strip()]
    for line in lines:
        own = line.split()
        if len(own) >= LINE_WORDS:
            worst = np.maximum(worst, _shares(line, own))
    return [
        float(x)
        for x in (
            np.log1p(n), (size - counts[9:14].sum() - counts[32]) / n, upper,
            counts[48:58].sum() / size, symbols, pipes, shouts, len(kinds) / n, stutter,
            max(kinds.values()) / n, counts[128:].sum() / size, counts[MARKS].sum() / n,
            worst[0], worst[3], worst[4], worst[2], worst[1], 1 - len(set(lines)) / len(lines),
        )
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features(texts: pa.Array) -> pa.Array:
    rows = [features_of(t) for t in texts.to_pylist()]
    return pa.array(rows, type=pa.list_(pa.float64()))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last one is the constant
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _design(x, self.mean, self.spread) @ self.weights


def _design(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -CLIP, CLIP)
    return np.hstack([z, np.ones((len(z), 1))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(gradient, size: int) -> np.ndarray:
    """Adam from zero with a fixed number of steps."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in u, from scores of both: the least ratio over high-score sets."""
    cuts = np.quantile(p, np.linspace(0, 1 - LEAST_SHARE, 81))
    of_p = np.array([(p >= c).mean() for c in cuts])
    of_u = np.array([(u >= c).mean() for c in cuts])
    return float(np.clip((of_u / of_p).min(), 0.01, 0.99))


def fit_arrays(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    both = np.vstack([positive, unlabelled])
    mean, spread = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = _design(positive, mean, spread), _design(unlabelled, mean, spread)
    size = p.shape[1]

    def first(w: np.ndarray) -> np.ndarray:
        gp = -(p * (1 - _sigmoid(p @ w))[:, None]).mean(axis=0)
        return gp + (u * _sigmoid(u @ w)[:, None]).mean(axis=0) + DECAY * w

    start = _descend(first, size)
    prior = estimate_prior(p @ start, u @ start)

    def risk(w: np.ndarray) -> np.ndarray:
        fp, fu = p @ w, u @ w
        as_zero = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_zero = (u * _sigmoid(fu)[:, None]).mean(axis=0) - prior * (
            p * _sigmoid(fp)[:, None]
        ).mean(axis=0)
        if as_zero < 0:
            return -g_zero
        g_one = -prior * (p * (1 - _sigmoid(fp))[:, None]).mean(axis=0)
        return g_one + g_zero + DECAY * w

    return Model(mean, spread, _descend(risk, size), prior)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f): the features of every row."""
    body = text_of(docs, text).cast("binary")
    return docs.select(column(docs, key).alias("doc_id"), features(body).alias("f"))


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Features of at most ``most`` rows, those with the smallest hash of their id.

    Rows are cut by the hash before they are ordered, to about what is needed.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(HASH_RANGE))
    share = min(1.0, 1.1 * most / max(1, rows.count()))
    few = rows.select("f", "doc_id", place.alias("at")).filter(
        F.col("at") < F.lit(int(np.ceil(share * HASH_RANGE)))
    )
    table = few.orderBy("at", "doc_id").limit(most).select("f").toArrow()
    return np.array(table["f"].to_pylist(), dtype=float).reshape(-1, len(NAMES))


def fit(rows: DataFrame, labels: DataFrame, held: Column, label: str = "quality") -> Model | None:
    """Learn from the rows (doc_id, f) and labels that ``held`` (of doc_id) does not hold out."""
    marks = (
        labels.select(F.col("doc_id").alias("_id"), column(labels, label).alias("_label"))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    known = written(
        rows.filter(~held).join(marks, F.col("doc_id") == F.col("_id"), "left")
        .select("doc_id", "f", "_label"),
        "training-rows",
    )
    positive = _sample(known.filter("_label = 1"), MAX_POSITIVES)
    unlabelled = _sample(known.filter("_label is null"), MAX_UNLABELLED)
    if not len(unlabelled):
        unlabelled = _sample(known, MAX_UNLABELLED)
    if not len(positive) or not len(unlabelled):
        return None
    return fit_arrays(positive, unlabelled)


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """Add the score (0 to 1) of rows with features ``f``."""
    if model is None:
        return rows.withColumn("score", F.lit(0.5))

    @F.arrow_udf(T.DoubleType())
    def probability(f: pa.Array) -> pa.Array:
        x = np.array(f.to_pylist(), dtype=float).reshape(-1, len(NAMES))
        return pa.array(_sigmoid(model.logits(x)), type=pa.float64())

    return rows.withColumn("score", probability("f"))
