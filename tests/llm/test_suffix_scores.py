"""Scores of the suffix tree by middle word, held against the definition."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelake import session
from tidelake.llm import suffix_scores, suffix_tree
from tidelake.llm.common import held_out, prepare


def corpus(n: int, length: int, words: int) -> list[tuple[int, str]]:
    """Texts with a very frequent word, frequent pairs, rare words and words seen once."""
    rng = random.Random(5)
    names = [f"w{k}" for k in range(words)]
    out = [(0, None), (1, ""), (2, "the"), (3, "The the THE"), (4, "only once"), (5, "the " * 40)]
    for i in range(6, n):
        text = []
        for _ in range(rng.randint(1, length)):
            word = names[min(words - 1, int(rng.paretovariate(0.8)) - 1)]
            text += rng.choice([[word], ["the", word], ["the", "end", "of", word], [f"x{rng.random()}", word]])
        out.append((i, " ".join(text)))
    return [*out, out[9], out[10]]


def by_definition(rows: list[tuple[int, str]]) -> dict[int, float]:
    """log10 scores from counts of all contexts, as the docstring of ``suffix_tree`` states them."""
    texts = {i: [*(t or "").lower().split(), None] for i, t in rows}
    learned = [texts[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = [Counter(tuple(t[k : k + d]) for t in learned for k in range(len(t) - d + 1)) for d in (1, 2, 3)]
    n, v = sum(counts[0].values()), len(counts[0])

    def root(word):
        return max(counts[0][word,] - 1, 0) / n + v / n / (v + 1)

    followers = [{}, {}]
    for d in (1, 2):
        for gram, c in counts[d].items():
            if c >= 2:
                followers[d - 1].setdefault(gram[:-1], {})[gram[-1]] = c
    states = {}

    def chance(context, word):
        if not context:
            return root(word)
        parent = chance(context[1:], word)
        if context not in states:
            return parent
        size, rest = states[context]
        c = followers[len(context) - 1][context].get(word, 1)
        return (c - 1) / size + rest / size * parent

    for d in (1, 2):
        for context, kept in followers[d - 1].items():
            size = counts[d - 1][context]
            rest = size - sum(c - 1 for c in kept.values())
            others, gain = max(size - 1, 1), 0.0
            for word, c in kept.items():
                parent = chance(context[1:], word)
                gain += c * math.log((max(c - 2, 0) / others + max(rest, 1) / others * parent) / parent)
            gain += (size - sum(kept.values())) * math.log(max(rest - 1, 0.5) / others)
            if gain > suffix_scores.GAIN * size and rest > 0 and (d == 1 or context[1:] in states):
                states[context] = size, rest
    assert {len(s) for s in states} == {1, 2}
    out = {}
    for i, text in texts.items():
        at = [tuple(text[max(0, k - 2) : k]) for k in range(len(text))]
        out[i] = sum(math.log10(chance(context, word)) for context, word in zip(at, text))
    return out


@pytest.mark.parametrize(
    "sizes",
    [{}, {"HOT": 30, "PART": 10, "BIN": 200, "BLOCK": 700, "SORTED": 100}, {"HOT": 2, "PART": 1, "BIN": 50}],
)
def test_scores_by_definition(spark, monkeypatch, sizes):
    """Blocks, bins and parts of frequent words change no score."""
    prepare(spark)
    for name, value in sizes.items():
        monkeypatch.setattr(suffix_scores, name, value)
    rows = corpus(120, 30, 40)
    want = by_definition(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_tree.scores(docs, held_out(F.col("doc_id"), 7, 2)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9)


def test_grams_are_not_written_out(spark, monkeypatch, tmp_path):
    """What is written stays below the texts: no table holds a row for each pair or triple."""
    prepare(spark)
    monkeypatch.setattr(session, "checkpoint_root", lambda spark: str(tmp_path))
    rng = random.Random(3)
    names = [f"word{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choices(names, k=1000))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_tree.scores(docs, held_out(F.col("doc_id"), 7, 2)).count() == len(rows)
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 0 < written < sum(len(t) for _, t in rows)


def test_unknown_rows_are_not_learned_from(spark):
    """A row that is neither held out nor not is scored, but not counted."""
    prepare(spark)
    rows = [(1, "a b c a b c", False), (2, "a b d d d", None), (3, "a b c", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r["doc_id"]: r for r in suffix_tree.scores(docs, F.col("held")).collect()}
    assert {i: (r["held_out"], r["n_known"], r["train_tokens"]) for i, r in got.items()} == {
        1: (False, 7, 7), 2: (None, 3, 7), 3: (True, 4, 7)
    }


def test_packed_columns_come_back():
    np = suffix_scores.np
    columns = [np.array([], np.int64), np.array([0, 5, 300]), np.array([1 << 40]), np.array([-0.5, 1e300])]
    data = suffix_scores.pack(*columns)
    assert [x.tolist() for x in suffix_scores.unpack(data)] == [x.tolist() for x in columns]
    assert suffix_scores.unpack(data, 1)[0].tolist() == [0, 5, 300]
