"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's words (lower case, runs of characters other than blank and U+0009-U+000D) make 3-word
shingles, repeats included; a bit of the 64-bit fingerprint is 1 if it is set in more than half
of the shingles' XXH64 values (seed 42). Two fingerprints are linked if at most ``RADIUS`` = 3
bits differ.

The search meets in the middle. Half the radius is 1.5, so one fingerprint of a pair must move
one bit and the other up to two, and parity tells which: a fingerprint with an even number of
ones emits its variants within one bit (65), one with an odd number those within two (2,081).
Two fingerprints at distance 1 or 3 differ in parity, two at distance 2 agree, so every linked
pair meets in a variant that at least one of them reaches with one bit. Variants are shuffled;
in each bucket all members are linked to the smallest one that is within one bit, which is a
true link (1 + 2 <= 3), so a bucket gives a line of links and not all pairs, and every linked
pair is joined through it. Links are deduplicated and verified by their differing bits.

Before that, fingerprints that cannot have a partner are set aside exactly: with three bits
spread over six blocks at least three blocks are equal, so a fingerprint that shares no three
blocks with any other is alone. This only saves variants; it drops no link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tidelake.llm.common import column, text_of
from tidelake.llm.components import components
from tidelake.session import written

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit number; no words give zero."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    begins, ends = begins[: len(words) - size + 1], ends[size - 1 :]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begins), CHUNK):
        spans = zip(begins[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        hashes = np.array([digest(joined[b:e], SEED) for b, e in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    majority = np.packbits(ones * 2 > len(begins), bitorder="little")
    return int(majority.view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(bytes(t)) for t in texts], dtype="int64")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _block_keys(fp: Column) -> Column:
    """One key for each choice of three blocks: the choice and the bits of its blocks."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    keys = []
    for number, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)):
        key = F.lit(number).cast("long")
        for i in chosen:
            bits = F.shiftrightunsigned(fp, starts[i]).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1))
            key = F.shiftleft(key, BLOCKS[i]).bitwiseOR(bits.cast("long"))
        keys.append(key)
    return F.array(*keys)


def _with_company(distinct: DataFrame) -> DataFrame:
    """The fingerprints that share three blocks with another one."""
    keyed = distinct.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    shared = written(shared.filter("a <> b").select("key"), "shared-blocks")
    return keyed.join(shared, "key", "left_semi").select("fp").distinct()


def _masks(most: int) -> Column:
    bits = range(BITS)
    masks = [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(bits, n)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.lit(np.array(signed, dtype=np.int64))


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that join all fingerprints ``fp`` at most ``RADIUS`` bits apart."""
    fp = F.col("fp")
    even = F.bit_count(fp) % 2 == 0
    near, far = _masks(RADIUS // 2), _masks((RADIUS + 1) // 2)
    balls = (
        _with_company(distinct)
        .select("fp", F.explode(F.when(even, near).otherwise(far)).alias("mask"))
        .select(
            "fp",
            fp.bitwiseXOR(F.col("mask")).alias("variant"),
            (F.bit_count("mask") <= RADIUS // 2).alias("close"),
        )
    )
    # A bucket holds distinct fingerprints within two bits of its variant: 2,081 at most.
    centre = F.min(F.when(F.col("close"), fp)).over(W.partitionBy("variant"))
    met = balls.select("fp", centre.alias("centre")).filter(fp != F.col("centre"))
    pairs = met.select(F.greatest("fp", "centre").alias("u"), F.least("fp", "centre").alias("v"))
    return pairs.distinct().filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` of the rows that linked fingerprints reach, the
    own one included. Defined cases: a NULL text counts as empty; texts without words have the
    fingerprint zero and are linked like others; texts of any length are taken whole; repeated
    rows give repeated results; NULL ids are passed over when the smallest is taken, and a
    component without any id has NULL; an empty table gives an empty one. Other columns are not
    read, whatever their names.
    """
    body = text_of(docs, text).cast("binary")
    marked = written(
        docs.select(column(docs, key).alias("doc_id"), fingerprints(body).alias("fp")),
        "fingerprints",
    )
    distinct = written(
        marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints"
    )
    found = components(links(distinct.select("fp")))
    found = written(found.select(F.col("node").alias("fp"), "root"), "roots")
    placed = written(
        distinct.join(found, "fp", "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root")
        ),
        "placed",
    )
    firsts = written(
        placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "components"
    )
    members = written(placed.join(firsts, "root").select("fp", "component_id"), "members")
    return marked.join(members, "fp").select(
        "doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the component's smallest: one row of each group.

    Repeated rows (same id and text) leave one. A row without an id goes if its group has one;
    a group that has none leaves one row of each fingerprint.
    """
    groups = near_duplicates(docs, key, text)
    own = column(docs, key)
    first = groups.filter(F.col("doc_id") == F.col("component_id"))
    first = first.select(F.col("doc_id").alias("_first")).distinct()
    kept = docs.join(first, own == first["_first"], "left_semi").dropDuplicates([key, text])
    nameless = groups.filter(F.col("component_id").isNull()).select("fingerprint").distinct()
    body = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("_row"),
                       own.alias("_key"), text_of(docs, text).alias("_text"))
    body = body.filter("_key is null").select(
        "_row", as_hex(fingerprints(F.col("_text").cast("binary"))).alias("fingerprint")
    )
    left = body.join(nameless, "fingerprint", "left_semi").dropDuplicates(["fingerprint"])
    return kept.unionByName(left.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
