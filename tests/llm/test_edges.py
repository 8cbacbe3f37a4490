"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelake.llm import (
    decontamination,
    html_text,
    language_id,
    licenses,
    pieces,
    quality_classifier,
    quality_rules,
    secrets,
    simhash,
    suffix_tree,
)
from tidelake.llm.common import held_out, prepare

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean,"
    " n_words string, spans string, _first long, _leaked long, word string, row long, t string,"
    " hash string, id string, `a.b` string, score string, size string, fp string"
)
LONG = "alpha beta gamma delta " * 40_000
CLASH = (True, "x", "y", 1, 2, "w", 9, "t", "h", "i", "d", "s", "z", "f")
ROWS = [
    (1, "One short text that is quite plain. It has words enough to pass the rules here.", "en"),
    (1, "One short text that is quite plain. It has words enough to pass the rules here.", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, LONG, None),
    (5, "   \n\t\n ", "de"),
    (None, "A row without any key, but with a text of its own that no other row repeats.", "en"),
    (None, None, None),
    (7, "éèê ñ ß 漢字 😀 � \x00 end", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(k, t, lang, None, len(t or ""), *CLASH) for k, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "What is the way of the plain word to the other end of it", "q"), (2, None, "q"), (3, "", "q")]
    return spark.createDataFrame(rows, "item_id long, text string, size string")


def test_quality_rules(docs, none):
    out = quality_rules.quality_rules(docs)
    assert set(out.columns) == set(docs.columns) | set(quality_rules.RESULTS)
    rows = out.select("doc_id", "n_words", "kept", "`a.b`").collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_words"] == by[2]["n_words"] == by[5]["n_words"] == 0
    assert by[4]["n_words"] == 160_000 and not by[4]["kept"] and by[1]["kept"]
    assert quality_rules.quality_rules(none).count() == 0
    assert quality_rules.keep_good(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"]


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    empty = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert sorted(str(r["doc_id"]) for r in empty) == ["2", "3", "5", "None"]
    assert {r["component_id"] for r in empty} == {2}
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "7", "None"]
    assert simhash.keep_first(none).count() == 0


def test_decontamination(docs, none, bench):
    assert decontamination.leaks(docs, bench).collect() == []
    assert decontamination.leaks(none, bench).collect() == []
    assert decontamination.leaks(docs, bench.limit(0)).collect() == []
    text = bench.first()["text"]
    dirty = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit(f"So: {text}!")).otherwise(F.col("text")))
    found = decontamination.leaks(dirty, bench)
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(1, 1)]
    clean = decontamination.keep_clean(dirty, found)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 2


def test_secrets(docs, none):
    out = secrets.secret_spans(docs, out="spans").select("doc_id", "spans").collect()
    assert len(out) == len(ROWS) and not any(r["spans"] for r in out)
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns
    got = {r["doc_id"]: r for r in masked.collect()}
    assert got[2]["text"] is None and got[4]["text"] == LONG and got[4]["n_chars"] == len(LONG)
    assert secrets.secret_spans(none).count() == 0 and secrets.redact(none).count() == 0


def test_pieces(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode_documents(docs, path)
    assert len(out.columns) == len(docs.columns) + len(pieces.RESULT_TYPE.names)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(r["agrees"] for r in rows.values())
    assert rows[2]["n_tokens"] == rows[3]["n_tokens"] == 2
    assert pieces.encode_documents(none, path).count() == 0


def test_pages(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<p>a<p>" * 20_000, "x"), (3, None, "<p>a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [r["text"] for r in html_text.extract_pages(pages).collect()]
    assert got[:2] == ["", ""] and got[2] == "\n".join(["a"] * 20_000) and got[3] == "a"
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_suffix_tree(docs, none):
    held = held_out(F.col("doc_id"), 7, 2)
    rows = suffix_tree.scores(docs, held).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[5]["n_tokens"] == 1
    assert by[4]["n_tokens"] == 160_001 and all(r["score"] <= 0 for r in rows)
    assert suffix_tree.scores(none, held).collect() == []
    unlearned = suffix_tree.scores(docs, F.lit(True)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in unlearned} == {(0, 0, 0.0)}


def test_licenses(docs, none):
    assert licenses.license_matches(docs).collect() == []
    assert licenses.license_matches(none).collect() == []


def test_language(docs, none):
    model = language_id.fit(docs)
    out = language_id.predict(docs, model, out="row").select("doc_id", "row.*").collect()
    got = {r["doc_id"]: r["lang_pred"] for r in out}
    assert got[2] == got[3] == got[5] == "und" and got[1] == "en" and got[4] != "und"
    empty = language_id.fit(none)
    assert empty.languages == []
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).select("language.*").collect()} == {"und"}
    only = language_id.fit(docs.filter("lang = 'en'"))
    assert language_id.decode(only, language_id.grams("x")) == ("en", 1.0, False)


def test_classifier(spark, docs, none):
    held = held_out(F.col("doc_id"), 5, 0)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1)], "doc_id long, quality int")
    rows = quality_classifier.measured(docs)
    model = quality_classifier.fit(rows, labels, held)
    out = quality_classifier.score(rows, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.fit(rows, labels.limit(0), held) is None
    assert {r["score"] for r in quality_classifier.score(rows, None).collect()} == {0.5}
    assert quality_classifier.score(quality_classifier.measured(none), model).count() == 0


def test_stages(spark, docs, sf):
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            assert out.count() <= len(ROWS), name
