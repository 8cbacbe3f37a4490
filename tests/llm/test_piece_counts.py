"""Token counts against the sentencepiece library."""

import public_tokenizers
import pytest
import sentencepiece

from tidelake.llm import piece_counts
from tidelake.llm.common import prepare, read
from tidelake.llm.registry import PIECES, QUERIES

MODEL = public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_query_against_the_library(spark, library):
    prepare(spark)
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, sf, "documents").collect()}
    rows = QUERIES["op12_token_counts"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_pre_tokens_are_counted_as_inside_texts(library):
    with open(MODEL, "rb") as f:
        counter = piece_counts.PieceCounter(f.read())
    texts = [
        "a b", " a", "a ", "  a   b  ", "a\nb", "\n", "\n\n x\n", "▁", "▁▁a▁b", " ▁ ", "é漢😀\x00\t",
        "tab\tand  two", "�", "x" * 5000, "<s></s><unk>", "\r\n a", "ﬁ Å ①", "a b c",
    ]
    for text in texts:
        units = piece_counts.pre_tokens(text)
        assert sum(counter.counts(units)) == len(library.encode(text)), text


@pytest.mark.parametrize("hot_bytes", [0, 40, 2 << 20])
def test_hot_pre_tokens_change_nothing(spark, library, monkeypatch, hot_bytes):
    prepare(spark)
    known = piece_counts.hot_units
    sizes = []

    def some(texts, model):
        hot = known(texts, model, hot_bytes)
        sizes.append(sum(len(u.encode()) for u in hot))
        return hot

    monkeypatch.setattr(piece_counts, "hot_units", some)
    rows = [(i % 7, f"the common words and the rare{i}word the end {'a' * (i % 9)}") for i in range(60)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    found = sorted(tuple(r) for r in piece_counts.token_counts(docs, MODEL).collect())
    assert found == sorted((k, len(t.encode()), len(library.encode(t))) for k, t in rows * 2)
    assert sizes[0] <= hot_bytes


def test_defined_cases(spark, library):
    prepare(spark)
    schema = "doc_id string, text string, name string, unit string, uses long, `a.b` string"
    clash = ("n", "u", 3, "d")
    long = "alpha  beta\n" * 30_000
    texts = [("a", "one two"), ("a", "one two"), ("a", "three"), (None, "one two"), (None, None), ("", "one two")]
    texts += [("b", None), ("c", ""), ("d", long), ("e", " \n\t"), ("f", "z" * 50_000)]
    docs = spark.createDataFrame([(*t, *clash) for t in texts], schema)
    order = lambda r: (r[0] is None, r[0] or "", r[1])
    found = sorted((tuple(r) for r in piece_counts.token_counts(docs, MODEL).collect()), key=order)
    want = [(k, len((t or "").encode()), len(library.encode(t or ""))) for k, t in texts]
    assert found == sorted(want, key=order)
    empty = piece_counts.token_counts(docs.limit(0), MODEL)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_tokens"]
