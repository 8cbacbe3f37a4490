"""The words that a text must hold to be looked up leave out no known text."""

from pyspark.sql import functions as F

from tidelake.llm import licenses
from tidelake.llm.common import prepare


def test_every_known_text_is_found_as_a_document_and_as_a_line(spark):
    known = licenses.known_texts()
    rows = [(i, t.upper() if i % 2 else t) for i, (_, t) in enumerate(known)]
    single = [(1000 + i, f"some words\n{t}\r\nmore words") for i, (_, t) in enumerate(known) if "\n" not in t]
    docs = prepare(spark).createDataFrame(rows + single, "doc_id long, text string")
    found = {(r["doc_id"], r["license"], r["scope"]) for r in licenses.license_matches(docs).collect()}
    assert {(i, name, "document") for i, (name, _) in enumerate(known)} <= found
    assert {(i, known[i - 1000][0], "line") for i, _ in single} <= found


def test_every_known_text_holds_one_of_the_words(spark):
    rows = prepare(spark).createDataFrame(licenses.known_texts(), "license string, text string")
    forms = [r[0] for r in rows.select(licenses.canonical(F.col("text"))).collect()]
    assert [c for c in forms if not any(w in c for w in licenses.WORDS)] == []
