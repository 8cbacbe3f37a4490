"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import (
    decontamination,
    fill_middle,
    html_text,
    language_id,
    licenses,
    piece_counts,
    pieces,
    quality_classifier,
    quality_rules,
    secrets,
    simhash,
    spelling,
    suffix_tree,
)
from tidelake.llm.common import held_out, prepare, read
from tidelake.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


PIECES = "piece_bpe_32k.model"


@query("op1_secret_scans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(read(spark, sf_dir, "documents"), out="_spans")
    base = F.filter("_spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{kind}") for kind in secrets.KINDS[: secrets.N_BASE]]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("_spans")).alias("spans"),
    )


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_pages(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))


@query("op5_benchmark_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )


@query("op6_quality_rules", quality_rules.sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules.quality_rules(read(spark, sf_dir, "documents"))
    return measured.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


@query("op7_license_scans", licenses.sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(read(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.filter(~held))
    out = language_id.predict(docs, model, out="_found")
    return out.select("doc_id", held.alias("held_out"), "_found.*")


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(quality_classifier.measured(read(spark, sf_dir, "documents")), "features")
    held = held_out(F.col("doc_id"), 5, 0)
    model = quality_classifier.fit(rows, read(spark, sf_dir, "labels"), held)
    scored = quality_classifier.score(rows, model)
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_documents(docs, public_tokenizers.path(PIECES))
    return coded.drop("text")


@query("op11_spelling_variants", spelling.sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counted = piece_counts.token_counts(docs, public_tokenizers.path(PIECES))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op13_fill_in_middle", fill_middle.sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_middle.fill_middle(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256"),
    )
