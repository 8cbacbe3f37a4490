"""Quality rules: base counts, and divergence from language references.

Every document is measured by plain counts (words, symbols, repeated lines and windows) and
by two histograms: character classes, and the commonest words of its language. A histogram is
compared with that of the language by the Jensen-Shannon distance (square root of the base-2
divergence, 0 to 1). Only DataFrame functions are used.

References come from all documents: a language is referenced if it has ``REFERENCE_WORDS`` words
of its own, whatever the others have. They are a table of ``COMMON_WORDS`` words and the classes
of each language, joined by language: Spark sends it to the tasks while it is small and shuffles
otherwise, so no number of languages is too large. A document whose language is NULL or has no
reference is not judged by its histograms.

Defined cases: a NULL text is the empty text; a text without words has only zero counts and
fails the base rules; texts of any length are measured whole; a histogram of fewer than
``MIN_CHARS`` characters or ``MIN_WORDS`` words is not judged (distance NULL); an empty table gives
an empty one. Rows are measured one by one, so repeated rows give repeated results, and other
columns pass through unless they carry a result's name, which the result then replaces. Ties among
common words go to the smaller word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelake.llm.common import column, text_of, words_of
from tidelake.session import written

WINDOW = 5
REFERENCE_WORDS = 5_000
# Only the SQL asks for this share of all words too, which binds beyond 20 million words.
MAX_LANGUAGES = 4_096
COMMON_WORDS = 16
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CHAR_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.28

SYMBOLS = "#*$%&|<>"
# What is left of a text without ASCII lower case and blanks is short; the classes are counted
# there, each as the length that its characters take. Bytes beyond one a character stand for
# the letters outside ASCII, and the last class is the rest.
PLAIN = "[a-z\\s]++"
CLASSES = {
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "symbol": "[#*$%&|<>+=@^_~`{}\\[\\]\\\\/]+",
    "mark": "[.,;:!?'\"()-]+",
}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _lost(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _class_counts(rest: Column, n_chars: Column, word_chars: Column) -> Column:
    """Counts by class: upper, digit, symbol, mark, space, bytes beyond ASCII, others."""
    cut = [_lost(rest, pattern) for pattern in CLASSES.values()]
    wide = F.octet_length(rest) - F.length(rest)
    named = [*cut, n_chars - word_chars, wide]
    others = F.greatest(F.lit(0), n_chars - sum(named[1:], named[0]))
    return F.array(*[c.cast("double") for c in [*named, others]])


def distance(counts: Column, total: Column, q: Column) -> Column:
    """Jensen-Shannon distance of counts that sum to ``total`` from an array of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    parts = F.zip_with(
        counts, q, lambda c, b: part(c / total, b) + part(b, c / total)
    )
    divergence = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), divergence)))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Histograms of every language with enough words, over all documents.

    (_ref, _ref_classes, _ref_words, _ref_shares): the language, the shares of the classes, the
    common words, and their shares with that of all others behind them.
    """
    body = docs.select(column(docs, lang).cast("string").alias("l"), text_of(docs, text).alias("t"))
    body = body.filter(F.col("l").isNotNull())
    counted = written(
        body.select("l", F.explode(words_of(F.col("t"))).alias("w"))
        .groupBy("l", "w")
        .agg(F.count("*").alias("n")),
        "word-counts",
    )
    sizes = counted.groupBy("l").agg(F.sum("n").alias("words"))
    kept = written(sizes.filter(F.col("words") >= REFERENCE_WORDS), "languages")
    own = body.join(kept.select("l"), "l", "left_semi")
    spaces = F.length("t") - F.length(F.regexp_replace("t", "\\s+", ""))
    classes = own.withColumn("_rest", F.regexp_replace("t", PLAIN, ""))
    classes = classes.select(
        "l", _class_counts(F.col("_rest"), F.length("t"), F.length("t") - spaces).alias("c")
    )
    sums = classes.groupBy("l").agg(
        F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(_N_CLASSES)]).alias("c")
    )
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    shares = sums.select("l", F.transform("c", lambda x: x / total).alias("_ref_classes"))
    order = W.partitionBy("l").orderBy(F.col("n").desc(), F.col("w"))
    ranked = counted.join(kept, "l")
    ranked = ranked.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= COMMON_WORDS)
    # COMMON_WORDS rows a language.
    top = ranked.groupBy("l").agg(
        F.sort_array(F.collect_list(F.struct("k", "w", (F.col("n") / F.col("words")).alias("q")))).alias("top")
    )
    common = F.transform("top", lambda x: x["q"])
    others = 1 - F.aggregate(common, F.lit(0.0), lambda a, x: a + x)
    words = top.select(
        "l",
        F.transform("top", lambda x: x["w"]).alias("_ref_words"),
        F.concat(common, F.array(others)).alias("_ref_shares"),
    )
    return written(shares.join(words, "l").withColumnRenamed("l", "_ref"), "references")


_N_CLASSES = len(CLASSES) + 3


def _measured(df: DataFrame, text: Column) -> DataFrame:
    """Add the words, their number and length, and the class counts."""
    out = df.withColumn("_words", words_of(text))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        }
    )
    out = out.withColumn("_rest", F.regexp_replace(text, PLAIN, ""))
    return out.withColumn(
        "_classes", _class_counts(F.col("_rest"), F.length(text), F.col("word_chars"))
    )


def _repeats(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside a window that the text holds twice or more.

    Windows are compared by a 64-bit hash within one text. Only a text with a repeated window
    sorts them: equal neighbours give the starts, and consecutive starts at most one window
    apart share words.
    """
    words, n = F.col("_words"), F.col("n_words")
    first = F.slice(words, F.lit(1), F.greatest(F.lit(0), n.cast("int") - (WINDOW - 1)))
    hashes = F.transform(
        first, lambda x, i: F.xxhash64(x, *[words[i + k] for k in range(1, WINDOW)])
    )
    df = df.withColumn("_windows", hashes)
    windows = F.col("_windows")
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_pairs", F.when(repeated, pairs))
    seen = F.col("_pairs")
    same = F.filter(
        seen,
        lambda x, k: (F.get(seen, k - 1)["h"].eqNullSafe(x["h"]))
        | (F.get(seen, k + 1)["h"].eqNullSafe(x["h"])),
    )
    df = df.withColumn("_starts", F.sort_array(F.transform(same, lambda x: x["i"])))
    at = F.col("_starts")
    width = F.transform(
        at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))
    )
    covered = F.aggregate(width, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def _distances(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Add char_distance and word_distance from the reference of the language, NULL without one."""
    df = df.join(refs, F.col("_lang") == F.col("_ref"), "left")
    names, words = F.col("_ref_words"), F.col("n_words").cast("double")
    # Each step is a column of its own: what a lambda names is then a value, not a computation.
    df = df.withColumns(
        {
            "_common": F.filter("_words", lambda x: F.array_contains(names, x)),
            "_total": F.aggregate("_classes", F.lit(0.0), lambda a, x: a + x),
        }
    )
    found = F.col("_common")
    each = F.transform(
        names, lambda w: (F.size(found) - F.size(F.array_remove(found, w))).cast("double")
    )
    df = df.withColumn("_each", each)
    rest = words - F.aggregate("_each", F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("_counts", F.concat("_each", F.array(rest)))
    by_class = distance(F.col("_classes"), F.col("_total"), F.col("_ref_classes"))
    by_word = distance(F.col("_counts"), words, F.col("_ref_shares"))
    known = F.col("_ref").isNotNull()
    return df.withColumns(
        {
            "char_distance": F.when(known & (F.col("word_chars") >= MIN_CHARS), by_class),
            "word_distance": F.when(known & (F.col("n_words") >= MIN_WORDS), by_word),
        }
    )


RESULTS = (*BASE, "char_distance", "word_distance", "base_failed", "kept")


def quality_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", refs: DataFrame | None = None
) -> DataFrame:
    """All columns of ``docs`` (but those named like a result) with the counts and the verdict.

    ``kept`` is false if the base rules fail (fewer than 10 words, or over a fifth of the words
    in repeated windows), or if a judged histogram is too far from its reference.
    """
    refs = references(docs, text, lang) if refs is None else refs
    plain = [c for c in docs.columns if c not in RESULTS]
    held = {f"_in{i}": column(docs, c) for i, c in enumerate(plain)}
    df = docs.select(
        *[c.alias(name) for name, c in held.items()],
        text_of(docs, text).alias("_text"),
        column(docs, lang).cast("string").alias("_lang"),
    )
    body = F.col("_text")
    df = _repeats(_measured(df, body))
    lines = F.filter(
        F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
    )
    df = df.withColumn("_lines", lines).withColumns(
        {
            "n_symbols": sum(
                F.length("_rest") - F.length(F.replace("_rest", F.lit(c), F.lit(""))) for c in SYMBOLS
            ).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    df = _distances(df, refs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > MAX_CHAR_DISTANCE) | (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) > MAX_WORD_DISTANCE
    )
    df = df.withColumn("base_failed", failed).withColumn("kept", ~(failed | far))
    return df.select(
        *[F.col(name).alias(c) for name, c in zip(held, plain)], *[F.col(c) for c in RESULTS]
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep.

    The row number keeps the optimizer from pushing the verdict below the columns that it is
    made of, which would compute each of them once for every mention.
    """
    plain = [column(docs, c) for c in docs.columns]
    body = docs.select(F.struct(*plain).alias("_row"), column(docs, text).alias("_t"),
                       column(docs, lang).alias("_l"))
    measured = quality_rules(body, "_t", "_l", references(docs, text, lang))
    marked = measured.select("_row", "kept", F.monotonically_increasing_id().alias("_at"))
    good = marked.filter(F.col("kept") & (F.col("_at") >= 0))
    return good.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def sql() -> str:
    """doc_id, the base counts, base_failed and kept in DuckDB; doc_id must be unique."""

    def lost(pattern: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"length(rest) - length(regexp_replace(rest, '{quoted}', '', 'g'))"

    cut = ", ".join(lost(p) for p in CLASSES.values())
    symbols = " + ".join(f"length(rest) - length(replace(rest, '{c}', ''))" for c in SYMBOLS)
    n = len(CLASSES)

    def part(a: str, b: str) -> str:
        return f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end"

    def jsd(a: str, b: str) -> str:
        return f"sqrt(greatest(0, sum({part(a, b)} + {part(b, a)}) / 2))"

    return rf"""
        with body as (
            select doc_id, lang, coalesce(text, '') as t,
                list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                    lambda x: x <> '') as w,
                regexp_replace(coalesce(text, ''), '[a-z\x20\x09-\x0D]+', '', 'g') as rest
            from documents
        ), plain as (
            select *, len(w) as n_words, length(array_to_string(w, '')) as word_chars from body
        ), cut as (
            select *, [{cut}] as found, strlen(rest) - length(rest) as wide,
                length(t) - word_chars as space
            from plain
        ), measured as (
            select *, list_transform(list_concat(found, [space, wide,
                greatest(0, length(t) - list_sum(found[2:]) - found[1] - space - wide)]),
                lambda x: x::double) as classes
            from cut
        ), counted as (
            select lang as l, x as word, count(*) as n
            from (select lang, unnest(w) as x from body where lang is not null) group by all
        ), sizes as (
            select l, sum(n) as words from counted group by l
            having sum(n) >= {REFERENCE_WORDS}
                and sum(n) >= (select sum(n) from counted) / {MAX_LANGUAGES}
        ), common as (
            select l, word, n, row_number() over (partition by l order by n desc, word) as k
            from counted join sizes using (l)
            qualify k <= {COMMON_WORDS}
        ), word_ref as (
            select l, word, k, n / words as q from common join sizes using (l)
            union all
            select l, null, 0, (any_value(words) - sum(n)) / any_value(words)
            from common join sizes using (l) group by l
        ), class_sums as (
            select lang as l, k, sum(classes[k]) as s
            from measured, range(1, {n + 4}) as r(k) where lang in (select l from sizes) group by all
        ), class_ref as (
            select l, k, s / sum(s) over (partition by l) as q from class_sums
        ), by_class as (
            select doc_id, l, {jsd('p', 'q')} as d from (
                select doc_id, l, q, classes[k] / list_sum(classes) as p
                from measured, class_ref where word_chars >= {MIN_CHARS}
            ) group by all
        ), hits as (
            select doc_id, x as word, count(*) as c
            from (select doc_id, unnest(w) as x from plain where n_words >= {MIN_WORDS}) group by all
        ), by_word as (
            select doc_id, l, {jsd('p', 'q')} as d from (
                select p.doc_id, r.l, r.q, case when k > 0 then coalesce(h.c, 0) else n_words
                    - sum(coalesce(h.c, 0)) over (partition by p.doc_id, r.l) end / n_words as p
                from plain p cross join word_ref r
                left join hits h on h.doc_id = p.doc_id and h.word = r.word
                where n_words >= {MIN_WORDS}
            ) group by all
        ), chosen as (
            select m.doc_id,
                max(c.d) filter (c.l = m.lang) as char_distance,
                max(b.d) filter (b.l = m.lang) as word_distance
            from measured m left join by_class c using (doc_id) left join by_word b using (doc_id)
            group by m.doc_id
        ), windows as (
            select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as x
            from (select doc_id, w, unnest(range(1, n_words - {WINDOW - 2})) as i from plain)
        ), twice as (
            select doc_id, i from windows qualify count(*) over (partition by doc_id, x) > 1
        ), covered as (
            select doc_id, count(distinct i + k) as n_repeat_words
            from twice, range({WINDOW}) as r(k) group by doc_id
        ), dup as (
            select doc_id, count(*) - count(distinct x) as n_dup_lines
            from (select doc_id, unnest(string_split(t, chr(10))) as x from body)
            where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id
        ), verdict as (
            select doc_id, n_words, word_chars, ({symbols})::bigint as n_symbols,
                coalesce(n_dup_lines, 0) as n_dup_lines,
                coalesce(n_repeat_words, 0) as n_repeat_words,
                n_words < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * n_words as base_failed,
                coalesce(char_distance, 0) > {MAX_CHAR_DISTANCE}
                    or coalesce(word_distance, 0) > {MAX_WORD_DISTANCE} as far
            from measured left join covered using (doc_id) left join dup using (doc_id)
            left join chosen using (doc_id)
        )
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            not (base_failed or far) as kept
        from verdict
    """
