"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Patterns (``assign``, ``access``, ``hex``) give the base spans. Candidates are runs of at least
``WINDOW`` characters of an alphabet that secrets use. Over each run of a character class
(``CLASSES``: hexadecimal digits of either case, or the whole alphabet) a window of ``WINDOW``
characters slides; the Shannon entropy of its character counts is kept up to date by taking one
character out and one in, and windows at or above the class's threshold join to spans
(``entropy_hex``, ``entropy_base64``). A candidate is judged in parts: names and values on both
sides of an equals sign. An allow-list suppresses parts that are known not to be secrets: numbers,
plain words and words joined by marks, UUIDs, samples, and the host and path of a web address, but
not its user, its query or what follows it on the same line. Spans inside a base span are not
repeated. The allow-list never removes a base span.

Positions are code points, end exclusive, in order of start and then of kind as listed in
``KINDS``. Defined cases: a NULL text counts as empty and has no spans; texts of any length are
scanned whole, in time linear in their length; repeated rows give repeated results; an empty
table gives an empty one; other columns pass through, but one that is named like the result gives
way to it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import column, text_of

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
N_BASE = 3
MASK = "[SECRET]"

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Class, its runs, and the least entropy in bits of a window.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]{20,}"), 3.0),
    ("entropy_base64", CANDIDATE, 3.9),
)
NUMBER = re.compile(r"[0-9+/_=-]+")
CAMEL = re.compile(r"(?:[A-Z][a-z]{2,}){2,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
SAMPLE = re.compile(r"(?i)example|sample|dummy|placeholder|0123456789|abcdefghij|x{6}")
MARKS = re.compile(r"[+/_=-]+")
# A word, an abbreviation or a short number between marks; longer ones may be keys.
WORD = re.compile(r"[A-Z]?[a-z]{0,24}|[A-Z]{1,24}|[0-9]{1,4}")
# The host and path of an address end at a query, a quote, a comma, a bracket or an at sign.
ADDRESS = re.compile(
    r"""(?:https?|ftp)://(?:[^\s"'`<>,;()\[\]{}|@?#/]*@)?([^\s"'`<>,;()\[\]{}|@?#]*)"""
)
VALUE = re.compile(r"[^=]+=*")

_PLOGP = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def hot_windows(run: str, least: float) -> list[tuple[int, int]]:
    """Joined windows of ``run`` whose entropy is at least ``least``."""
    counts: dict[str, int] = {}
    total = 0.0
    most = WINDOW * (math.log2(WINDOW) - least) + 1e-9
    spans: list[tuple[int, int]] = []
    for i, char in enumerate(run):
        if i >= WINDOW:
            gone = run[i - WINDOW]
            n = counts[gone]
            total += _PLOGP[n - 1] - _PLOGP[n]
            counts[gone] = n - 1
        n = counts.get(char, 0)
        total += _PLOGP[n + 1] - _PLOGP[n]
        counts[char] = n + 1
        begin = i - WINDOW + 1
        if begin >= 0 and total <= most:
            if spans and begin <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((begin, i + 1))
    return spans


def _allowed(part: str) -> bool:
    return (
        any(p.fullmatch(part) for p in (NUMBER, CAMEL, UUID))
        or SAMPLE.search(part) is not None
        or all(map(WORD.fullmatch, MARKS.split(part)))
    )


def _parts(text: str):
    """Begin and end of the parts of candidates that are long enough and not allowed."""
    addresses = [m.span(1) for m in ADDRESS.finditer(text)] if "://" in text else []
    begins = [a for a, _ in addresses]
    for candidate in CANDIDATE.finditer(text):
        at = bisect_right(begins, candidate.start()) - 1
        if at >= 0 and candidate.start() < addresses[at][1]:
            continue
        for part in VALUE.finditer(text, *candidate.span()):
            if part.end() - part.start() >= WINDOW and not _allowed(part[0]):
                yield part.span()


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, in order."""
    found: list[tuple[int, int, int]] = []
    lowered = text.lower()
    if any(hint in lowered for hint in HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    # The farthest end of the base spans that begin up to each place.
    begins = [s for s, _, _ in found]
    ends = list(accumulate((e for _, _, e in found), max))
    for begin, end in _parts(text):
        for kind, (_, runs, least) in enumerate(CLASSES, N_BASE):
            for run in runs.finditer(text, begin, end):
                for b, e in hot_windows(run[0], least):
                    span = (run.start() + b, kind, run.start() + e)
                    at = bisect_right(begins, span[0]) - 1
                    if at < 0 or ends[at] < span[2]:
                        found.append(span)
    return sorted(found)


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("base", T.BooleanType()),
    ]
)
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
)


@F.arrow_udf(T.ArrayType(SPAN))
def find_spans(texts: pa.Array) -> pa.Array:
    rows = [
        [
            {"kind": KINDS[k], "start": s, "end": e, "base": k < N_BASE}
            for s, k, e in spans_of(text)
        ]
        for text in texts.to_pylist()
    ]
    return pa.array(rows, type=_ARROW)


def masked(text: str) -> str:
    """The text with every run of overlapping spans replaced by the mask."""
    out, at = [], 0
    joined: list[list[int]] = []
    for start, _, end in spans_of(text):
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    for start, end in joined:
        out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]]) if joined else text


@F.arrow_udf(T.StringType())
def mask_text(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else masked(t) for t in texts.to_pylist()], type=pa.string())


def secret_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """All columns of ``docs`` and the array of spans of its whole text."""
    return docs.withColumn(out, find_spans(text_of(docs, text)))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with the spans of its texts masked; the length column follows if there is one."""
    out = docs.withColumn(text, mask_text(column(docs, text).cast("string")))
    if length in docs.columns:
        size = F.length(column(out, text)).cast(docs.schema[length].dataType)
        out = out.withColumn(length, size)
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
