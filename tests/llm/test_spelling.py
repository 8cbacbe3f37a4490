"""Spelling variants against brute force: the index, the blocks, roots, edge cases, SQL."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelake.llm import spelling
from tidelake.llm.common import prepare, read
from tidelake.llm.registry import QUERIES

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def near_of(words):
    """Near words by the deletion variants of each word."""
    by_rest = {}
    for w in words:
        for rest in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_rest.setdefault(rest, []).append(w)
    near = {w: set() for w in words}
    for some in by_rest.values():
        for a in some:
            near[a] |= {b for b in some if one_edit(a, b)}
    return near


def brute(counts):
    near, forms = near_of(counts), {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, forms[w], root, n, len(near[w]), counts.get(forms[w])))
    return rows


def brute_counts(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def rows_of(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters,sizes", [("ab", (5, 9)), ("abcé", (5, 7)), ("xyzÀÿ×", (5, 6))])
def test_index_finds_exactly_the_words_one_edit_away(letters, sizes):
    rng = random.Random(letters)
    for count in (1, 2, 10, 150):
        words = sorted({"".join(rng.choices(letters, k=rng.randint(*sizes))) for _ in range(count)})
        index = spelling.BidirectionalIndex(words)
        asked = [*words, "qqqqq", letters[0] * 5, letters[0] * 6]
        found, both = set(), 0
        for right in (True, False):
            q, w = index.near(asked, right)
            found |= {(asked[a], words[b]) for a, b in zip(q.tolist(), w.tolist())}
        assert found == {(a, b) for a in asked for b in words if one_edit(a, b)}


def test_index_holds_very_long_words():
    long = "ab" * 3000
    words = sorted({long, long + "a", long[:1000] + "c" + long[1001:], "abababab"})
    index = spelling.BidirectionalIndex(words)
    found = set()
    for right in (True, False):
        q, w = index.near(words, right)
        found |= {(words[a], words[b]) for a, b in zip(q.tolist(), w.tolist())}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_wavelet_counts():
    import numpy as np

    rng = np.random.default_rng(1)
    sequence = rng.integers(0, 11, 500)
    matrix = spelling.WaveletMatrix(sequence, 4)
    low = rng.integers(0, 500, 200)
    high = np.minimum(low + rng.integers(0, 100, 200), 500)
    symbol = rng.integers(0, 11, 200)
    a, b, smaller = matrix.narrow(symbol, low, high)
    for i in range(200):
        part = sequence[low[i] : high[i]]
        assert a[i] == (sequence[: low[i]] == symbol[i]).sum()
        assert b[i] - a[i] == (part == symbol[i]).sum()
        assert smaller[i] == (part < symbol[i]).sum()
    row, found, *_ = matrix.symbols(low, high)
    for i in range(200):
        assert sorted(found[row == i]) == sorted(set(sequence[low[i] : high[i]]))


def test_query_against_brute_force(spark, sf):
    prepare(spark)
    docs = read(spark, sf, "documents").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op11_spelling_variants"](spark, sf)) == brute(brute_counts(docs))


def test_halves_that_are_dealt_out_over_blocks(spark, monkeypatch):
    """Every word has one prefix, so one half holds all of them."""
    prepare(spark)
    rng = random.Random(2)
    counts = {"prefix" + "".join(rng.choices("abc", k=rng.randint(4, 6))): rng.randint(3, 90) for _ in range(400)}
    counts |= {w[::-1]: n for w, n in counts.items()}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = near_of(counts)
    want = {w: (len(s), min(s, key=lambda x: (-counts[x], x))) for w, s in near.items() if s}
    for block in (50_000, 40):
        monkeypatch.setattr(spelling, "BLOCK", block)
        monkeypatch.setattr(spelling, "TOGETHER", 64)
        best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))["form"]
        found = spelling.near_words(words).groupBy("word").agg(F.sum("n_near"), best).collect()
        assert {r[0]: (r[1], r[2]) for r in found} == want


def test_roots_follow_long_chains(spark):
    chain = [f"w{i}" for i in range(50)]
    rows = [*zip(chain, chain[1:]), (chain[-1], None), ("alone", None), ("x", chain[30])]
    forms = spark.createDataFrame(rows, "word string, form string")
    found = {r["word"]: r["root"] for r in spelling.roots(forms).collect()}
    assert found == {w: chain[-1] for w in [*chain[:-1], "x"]}


def test_defined_cases(spark):
    prepare(spark)
    schema = "doc_id long, text string, word string, n long, half string, `a.b` string"
    clash = ("w", 1, "h", "d")
    texts = [
        (1, "Colour colour COLOUR colour color color color", *clash),
        (1, "Colour colour COLOUR colour color color color", *clash),
        (None, "colours colours colours Élan élan ÉLAN", *clash),
        (2, None, *clash),
        (3, "", *clash),
        (4, "tiny tiny tiny " * 3, *clash),
        (5, "x" * 100_000 + " " + "y" * 7 + " yyyyyyy yyyyyyy", *clash),
        (6, "bbbbb1ccccc,bbbbb ccccc_ccccc bbbbb", *clash),
    ]
    docs = spark.createDataFrame(texts, schema)
    want = brute(brute_counts([t[:2] for t in texts]))
    assert rows_of(spelling.spelling_variants(docs)) == want
    assert {w for w, *_ in want} >= {"colour", "color", "colours", "yyyyyyy"}
    empty = spelling.spelling_variants(docs.limit(0))
    assert empty.collect() == [] and empty.columns == list(COLUMNS)


def test_ties_go_to_the_smallest_word(spark):
    prepare(spark)
    text = " ".join(["caper"] * 3 + ["taper"] * 6 + ["paper"] * 6 + ["zaper"] * 6)
    docs = spark.createDataFrame([(10**6, text)], "doc_id long, text string")
    rows = {r["word"]: r for r in spelling.spelling_variants(docs).collect()}
    assert (rows["caper"]["form"], rows["caper"]["root"], rows["caper"]["n_near"]) == ("paper", "paper", 3)
    assert rows["paper"]["form"] is None and rows["paper"]["root"] == "paper"
