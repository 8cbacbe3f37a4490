"""A language is learned whatever its share of the corpus."""

from pyspark.sql import functions as F

from tidelake.llm import language_id, quality_rules
from tidelake.llm.common import prepare, read


def test_a_rare_language_is_identified(spark):
    """Under 1/128 of the training rows."""
    docs = read(prepare(spark), "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text")
    ids = [r["doc_id"] for r in docs.filter("lang = 'de'").orderBy("doc_id").limit(4).collect()]
    mixed = docs.filter((docs["lang"] == "en") | docs["doc_id"].isin(ids))
    assert mixed.count() > 128 * len(ids)
    model = language_id.fit(mixed)
    assert "de" in model.languages
    rows = language_id.predict(mixed.filter("lang = 'de'"), model, out="row").select("row.*").collect()
    assert len(rows) == len(ids) and all(r["lang_pred"] == "de" for r in rows)


def test_documents_of_a_rare_language_are_not_measured_against_another(spark):
    """Five documents give no reference; what the rest of the corpus holds changes no verdict."""
    docs = read(prepare(spark), "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text")
    whole = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).drop("text").collect()}
    german = [r["doc_id"] for r in whole.values() if r["lang"] == "de" and r["kept"] and r["n_words"] >= 100]
    few = docs.filter((docs["lang"] != "de") | docs["doc_id"].isin(sorted(german)[:5]))
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(few).drop("text").collect()}
    for key in sorted(german)[:5]:
        assert rows[key]["kept"] and rows[key]["word_distance"] is None
    others = [k for k in rows if rows[k]["lang"] != "de"]
    assert len(others) > 500
    assert all(rows[k]["kept"] == whole[k]["kept"] for k in others)

    nameless = docs.withColumn("lang", F.lit(None).cast("string"))
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.quality_rules(nameless).collect())
