"""A language with enough words of its own has a reference, however much the others hold."""

from tidelake.llm import quality_rules
from tidelake.llm.common import prepare


def test_a_small_share_of_all_words_loses_no_reference(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "REFERENCE_WORDS", 150)
    monkeypatch.setattr(quality_rules, "MAX_LANGUAGES", 2)
    rows = [(i, "big", "alpha beta gamma delta " * 100) for i in range(20)]
    rows += [(100 + i, "rare", " ".join(f"{w}{i}{k % 40}" for k in range(200) for w in ("x",))) for i in range(2)]
    rows += [(200, "tiny", "one two three")]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, lang string, text string")
    assert {r["_ref"] for r in quality_rules.references(docs).collect()} == {"big", "rare"}
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).drop("text").collect()}
    assert len(found) == len(rows)
    assert found[100]["word_distance"] is not None and found[200]["word_distance"] is None


def test_references_too_large_to_send_are_joined_by_key(spark):
    """More languages than a broadcast holds give the verdicts of one."""
    rows = [(i, f"l{i % 5}", f"alpha{i % 5} beta gamma delta epsilon " * 300) for i in range(25)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, lang string, text string")

    def verdicts():
        cells = quality_rules.quality_rules(docs).select("doc_id", "char_distance", "word_distance", "kept")
        return sorted(map(tuple, cells.collect()))

    sent = verdicts()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        measured = quality_rules.quality_rules(docs)
        plan = measured._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert verdicts() == sent and all(r[2] is not None for r in sent)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
