"""Fill-in-middle transformation: texts cut at two token boundaries and put in another order.

A token is a word with the white space before it, or white space that ends the text. The code
point offsets at which tokens end, and 0, are the boundaries of a text. They are kept in a
``BoundarySet``: the offsets are split by their high 16 bits into containers, each an array of
low halves, a bitmap of 65,536 bits or a list of runs, whichever is smallest, next to the
cumulative cardinalities of the containers. The offset after ``k`` tokens is ``select(k)``: a
binary search of the cumulative cardinalities finds the container, and a select inside it finds
the offset.

The two cuts, whether a text is reordered at all, and into which form, follow from the sha256 of
a seed and the document's key, so they are the same on every run. The forms are ``plain`` (the
text), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle).

Defined cases: a NULL text counts as empty and is plain; a NULL key counts as the empty text; a
text that holds a mark is plain, so marks are never ambiguous; texts of any length are cut whole;
repeated rows give repeated results; an empty table gives an empty one; other columns pass
through, but one that is named like a result gives way to it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import SPACES, column, text_of

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

LOW_BITS = 16
SPAN = 1 << LOW_BITS
BITMAP_BYTES = SPAN // 8


class ArrayContainer:
    """Sorted low halves."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """One bit per low half, with the number of bits before each 64-bit word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


class RunContainer:
    """Runs of consecutive low halves, with the number of values before each run."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


Container = ArrayContainer | BitmapContainer | RunContainer


def container(low: np.ndarray) -> Container:
    """The smallest container for sorted distinct low halves."""
    gaps = np.flatnonzero(np.diff(low) != 1)
    starts = np.concatenate([[0], gaps + 1])
    sizes = {"run": 4 * len(starts), "array": 2 * len(low), "bitmap": BITMAP_BYTES}
    smallest = min(sizes, key=sizes.get)
    if smallest == "run":
        return RunContainer(low[starts], np.diff(np.concatenate([starts, [len(low)]])))
    return ArrayContainer(low) if smallest == "array" else BitmapContainer(low)


class BoundarySet:
    """A set of offsets that answers ``select``."""

    def __init__(self, offsets: np.ndarray):
        """``offsets`` are sorted and distinct."""
        high = offsets >> LOW_BITS
        first = np.concatenate([[0], np.flatnonzero(np.diff(high)) + 1])
        last = np.concatenate([first[1:], [len(offsets)]])
        self.high = high[first].tolist()
        self.containers = [
            container(offsets[a:b] & (SPAN - 1)) for a, b in zip(first.tolist(), last.tolist())
        ]
        # Values up to and with each container.
        self.cumulative = last.tolist()

    def __len__(self) -> int:
        return self.cumulative[-1]

    def select(self, k: int) -> int:
        """The offset with exactly ``k`` smaller ones."""
        at = bisect_right(self.cumulative, k)
        before = self.cumulative[at - 1] if at else 0
        return (self.high[at] << LOW_BITS) | self.containers[at].select(k - before)

    def rank(self, offset: int) -> int:
        """How many offsets are smaller."""
        return bisect_left(range(len(self)), offset, key=self.select)


_SPACE_POINTS = np.array([ord(c) for c in SPACES], dtype=np.uint32)


def boundaries(text: str) -> BoundarySet:
    """Offset 0 and the end of every token of ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    blank = np.isin(points, _SPACE_POINTS)
    # A token ends where a word does, and at the end of the text.
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 if len(points) > 1 else []
    tail = [len(points)] if len(points) else []
    return BoundarySet(np.concatenate([[0], ends, tail]).astype(np.int64))


def cut(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Tokens of ``text``, and the smaller and larger offset the two draws fall on."""
    ends = boundaries(text)
    a, b = first % len(ends), second % len(ends)
    return len(ends) - 1, ends.select(min(a, b)), ends.select(max(a, b))


def joined(text: str, form: str, a: int, b: int) -> str:
    """The text in the order of its form, cut at ``a`` and ``b``."""
    if form == PSM:
        return f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
    if form == SPM:
        return f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return text


def rebuilt(output: str, form: str) -> str:
    """The text an output was made of. A part holds no mark, so the first one ends it."""
    if form == PLAIN:
        return output
    outer, inner = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(outer).split(inner, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == PSM else two + middle + one


RESULT = pa.struct(
    [
        ("n", pa.int64()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.string()),
    ]
)
RESULT_TYPE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


@F.arrow_udf(RESULT_TYPE)
def _cut_texts(texts: pa.Array, forms: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    rows = []
    draws = zip(texts.to_pylist(), forms.to_pylist(), first.to_pylist(), second.to_pylist())
    for text, form, one, two in draws:
        n, a, b = cut(text, one, two)
        plain = form == PLAIN
        rows.append(
            {
                "n": n,
                "prefix_chars": None if plain else a,
                "middle_chars": None if plain else b - a,
                "output": joined(text, form, a, b),
            }
        )
    return pa.array(rows, type=RESULT)


@F.arrow_udf(T.StringType())
def restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """Texts rebuilt from their outputs and forms."""
    pairs = zip(outputs.to_pylist(), forms.to_pylist())
    return pa.array([rebuilt(output, form) for output, form in pairs], type=pa.string())


def draw(key: Column, place: int, seed: int) -> Column:
    """The ``place``-th 32 bits (from 0) of the sha256 of ``seed:key``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * place + 1, 8), 16, 10).cast("long")


def fill_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    cut_percent: int = 50,
    spm_percent: int = 80,
) -> DataFrame:
    """All columns of ``docs`` with n, form, prefix_chars, middle_chars and output.

    ``cut_percent`` of the documents are reordered, ``spm_percent`` of those with the suffix first.
    The offsets are code points, and NULL for a plain text.
    """
    whole, drawn = text_of(docs, text), [draw(column(docs, key), i, seed) for i in range(4)]
    marked = F.greatest(*[F.contains(whole, F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    form = (
        F.when((whole == "") | marked | (drawn[2] % 100 >= cut_percent), PLAIN)
        .when(drawn[3] % 100 < spm_percent, SPM)
        .otherwise(PSM)
    )
    results = ("n", "form", "prefix_chars", "middle_chars", "output")
    plain = [c for c in docs.columns if c not in results]
    held = {f"_in{i}": column(docs, c) for i, c in enumerate(plain)}
    named = docs.select(
        *[c.alias(name) for name, c in held.items()],
        whole.alias("_text"),
        form.alias("_form"),
        drawn[0].alias("_first"),
        drawn[1].alias("_second"),
    )
    out = named.withColumn("_out", _cut_texts("_text", "_form", "_first", "_second"))
    return out.select(
        *[F.col(name).alias(c) for name, c in zip(held, plain)],
        F.col("_out.n").alias("n"),
        F.col("_form").alias("form"),
        *[F.col(f"_out.{c}").alias(c) for c in ("prefix_chars", "middle_chars", "output")],
    )


def sql(seed: int = 42, cut_percent: int = 50, spm_percent: int = 80) -> str:
    """The results of the query for DuckDB."""
    token = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    marked = " OR ".join(f"contains(body, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    groups = ", ".join(
        f"('0x' || substr(sha256('{seed}:' || doc_id), {8 * i + 1}, 8))::BIGINT AS h{i + 1}"
        for i in range(4)
    )
    return f"""
WITH whole AS (
    SELECT doc_id, coalesce(text, '') AS body, {groups},
           regexp_extract_all(coalesce(text, ''), '{token}') AS tokens
    FROM documents
), cuts AS (
    SELECT doc_id, body, tokens, len(tokens) AS n,
           least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
           greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
           CASE WHEN body = '' OR {marked} OR h3 % 100 >= {cut_percent} THEN '{PLAIN}'
                WHEN h4 % 100 < {spm_percent} THEN '{SPM}' ELSE '{PSM}' END AS form
    FROM whole
), parts AS (
    SELECT doc_id, n, form, body,
           array_to_string(tokens[1:a], '') AS prefix,
           array_to_string(tokens[a + 1:b], '') AS middle,
           array_to_string(tokens[b + 1:], '') AS suffix
    FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> '{PLAIN}' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> '{PLAIN}' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN '{PLAIN}' THEN body
              WHEN '{PSM}' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle
              END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""
