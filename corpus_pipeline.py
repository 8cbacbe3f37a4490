"""Corpus cleaning: quality rules, near-duplicates, decontamination, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet
in the shared folder and gives what it reads back to the next one. All stages but the last keep
the columns of ``documents``; the last returns one row per document with its token counts and
digests. A stage has the operator's results for nulls, empty, very long and repeated texts, empty
tables and extra columns; see their docstrings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelake.llm import decontamination, pieces, quality_rules, secrets, simhash
from tidelake.llm.common import prepare, read
from tidelake.llm.registry import PIECES
from tidelake.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    prepare(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints stays."""
    prepare(spark)
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    prepare(spark)
    found = decontamination.leaks(docs, read(spark, sf_dir, "benchmark"))
    return decontamination.keep_clean(docs, found)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    prepare(spark)
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, agrees."""
    prepare(spark)
    coded = pieces.encode_documents(docs, public_tokenizers.path(PIECES))
    return coded.select("doc_id", *pieces.RESULT_TYPE.names)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", mask_secrets),
    ("sentencepiece", tokenize),
]

# The agenda of merges in the last stage has no SQL form; tests hold it against the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, over the whole table of documents."""
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
