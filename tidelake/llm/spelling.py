"""Spelling variant grouping: words one edit apart, found by bidirectional FM-index search.

Words are maximal runs of Latin letters of the texts, lower-cased in A-Z; of one run in 97, by a
checksum of document and run, one letter is left out. Two words are near if one code point is
inserted, deleted or replaced. One edit leaves the left or the right half of a word as it is, so
the search scheme has two searches: match the left half exactly and extend to the right allowing
one error, or match the right half and extend to the left.

A ``BidirectionalIndex`` holds a block of the vocabulary as one text with a delimiter around each
word, and the suffix order of this text and of its mirror image. A match is an interval of
suffix ranks in both orders; taking in a symbol on either side shrinks it. The ranks in a
transform are counted by a wavelet matrix, for many matches at a time. A whole word between its
delimiters has the rank of the word in the block.

Spark deals the vocabulary out by halves: a word lies in the blocks of each prefix and suffix that
can be the untouched half of a near word, and asks in those of its own two halves, so every link
is found in the block of the half that both words share. A half with more than ``BLOCK`` words is
dealt out over several blocks, and its words ask in all of these. A link whose words share both
halves counts for the left one alone.

A word's form is its near word of largest count, if that is at least twice its own; roots are
found by pointer jumping, in at most six rounds, as counts double along a chain.

Defined cases: NULL and empty texts have no words; a NULL key counts as the empty text; texts and
words of any length count whole; ties between forms go to the smallest word by code points;
repeated rows count each; an empty table gives an empty one; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import column, text_of
from tidelake.session import written

# Runs, the share of runs that lose a letter, and what counts as a word.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOSES = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2

# Words of a block, and words that search it side by side.
BLOCK = 50_000
TOGETHER = 8_192
# Distinct words that a task gathers before it passes them on.
GATHERED = 200_000
# Counts are below 2 to the 63rd and double along a chain of forms.
JUMPS = 6

_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}


# Words ---------------------------------------------------------------------------------------


def words_of(key: str, text: str) -> Counter[str]:
    """Lower-cased runs of one document, some without one of their letters, with their counts."""
    runs: Counter[str] = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        runs[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    words: Counter[str] = Counter()
    for run, n in runs.items():
        code = zlib.crc32(f"{key}:{run}".encode())
        if code % LOSES == 0:
            at = code % len(run)
            run = run[:at] + run[at + 1 :]
        words[run] += n
    return words


def _emit(found: Counter[str]) -> pa.RecordBatch:
    found = {w: n for w, n in found.items() if len(w) >= LEAST_LENGTH}
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
        names=["word", "n"],
    )


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            found.update(words_of(key, text))
            if len(found) >= GATHERED:
                yield _emit(found)
                found = Counter()
    yield _emit(found)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of enough letters and occurrences, counted over all documents."""
    name = F.coalesce(column(docs, key).cast("string"), F.lit(""))
    rows = docs.select(name.alias("key"), text_of(docs, text).alias("text"))
    seen = rows.mapInArrow(_gather, "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# The index -----------------------------------------------------------------------------------

# Symbols: 0 stands before the text, 1 is the delimiter, letters follow in code point order.
DELIMITER = 1


class WaveletMatrix:
    """Counts of symbols in ranges of a sequence, for arrays of ranges."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for level in reversed(range(bits)):
            ones = (sequence >> level & 1).astype(bool)
            before = np.zeros(len(sequence) + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((level, before, len(sequence) - int(before[-1])))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        # Where each symbol begins in the order of the last level.
        self.begin = np.zeros(1 << bits, dtype=np.int64)
        symbols, first = np.unique(sequence, return_index=True)
        self.begin[symbols] = first

    def narrow(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Of each range: its symbol's count before it and up to its end, and of smaller symbols."""
        smaller = np.zeros_like(low)
        for level, before, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            low1, high1 = before[low], before[high]
            smaller += np.where(one, (high - high1) - (low - low1), 0)
            low = np.where(one, zeros + low1, low - low1)
            high = np.where(one, zeros + high1, high - high1)
        # A symbol that does not occur has an empty range, whatever it begins at.
        return low - self.begin[symbol], high - self.begin[symbol], smaller

    def symbols(self, low: np.ndarray, high: np.ndarray):
        """Every symbol of every range: the range's number, the symbol, and as ``narrow``."""
        row = np.arange(len(low))
        symbol, smaller = np.zeros_like(low), np.zeros_like(low)
        for _, before, zeros in self.levels:
            low1, high1 = before[low].astype(np.int64), before[high].astype(np.int64)
            low0, high0 = low - low1, high - high1
            left, right = np.flatnonzero(high0 > low0), np.flatnonzero(high1 > low1)
            row = np.concatenate([row[left], row[right]])
            symbol = np.concatenate([symbol[left] << 1, symbol[right] << 1 | 1])
            smaller = np.concatenate([smaller[left], (smaller + high0 - low0)[right]])
            low = np.concatenate([low0[left], (zeros + low1)[right]])
            high = np.concatenate([high0[left], (zeros + high1)[right]])
        return row, symbol, low - self.begin[symbol], high - self.begin[symbol], smaller


def _transform(words: list[np.ndarray]) -> np.ndarray:
    """The symbol before every suffix of the delimited text of sorted ``words``, in suffix order.

    The delimiter that ends the text comes first, the others in the order of the words they
    stand before, so that the delimiter's rows are in the order of the words.
    """
    ends = np.cumsum([0] + [len(w) + 1 for w in words])
    text = np.full(ends[-1] + 1, DELIMITER, dtype=np.int64)
    for begin, word in zip(ends.tolist(), words):
        text[begin + 1 : begin + 1 + len(word)] = word
    rank = text + len(ends)
    rank[ends] = np.arange(1, len(ends) + 1)
    rank[ends[-1]] = 0
    # Prefix doubling: each round orders suffixes by twice as many symbols. No delimiter is like
    # another one, so comparisons end inside a word.
    step = 1
    while True:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] if step < len(rank) else 0
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
        if rank[order[-1]] == len(text) - 1:
            break
        step *= 2
    return np.where(order > 0, text[order - 1], 0)


class BidirectionalIndex:
    """Suffix ranks of a block of words, and of their mirror images."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        letters = sorted(set("".join(self.words)))
        self.code = {c: i for i, c in enumerate(letters, DELIMITER + 1)}
        # One symbol more, for letters that are in no word of the block.
        self.absent = DELIMITER + 1 + len(letters)
        bits = self.absent.bit_length()
        coded = [self.encode(w) for w in self.words]
        mirrored = [self.encode(w) for w in sorted(w[::-1] for w in self.words)]
        left = _transform(coded)
        self.left, self.right = WaveletMatrix(left, bits), WaveletMatrix(_transform(mirrored), bits)
        counts = np.bincount(left, minlength=self.absent + 1)
        counts[0] = 1  # the text's last delimiter, which stands before nothing
        self.first = np.cumsum(counts) - counts
        self.rows = len(self.words) + 1

    def encode(self, word: str) -> np.ndarray:
        return np.array([self.code.get(c, self.absent) for c in word], dtype=np.int64)

    def start(self, n: int) -> tuple[np.ndarray, ...]:
        """The match of one delimiter, ``n`` times: low and high rank, and low rank mirrored."""
        zeros = np.zeros(n, dtype=np.int64)
        return zeros, zeros + self.rows, zeros

    def extend(self, match, symbol: np.ndarray, right: bool):
        """Matches with one more symbol at the right or at the left side."""
        low, high, mirror = match
        if right:
            a, b, smaller = self.right.narrow(symbol, mirror, mirror + high - low)
            return low + smaller, low + smaller + b - a, self.first[symbol] + a
        a, b, smaller = self.left.narrow(symbol, low, high)
        return self.first[symbol] + a, self.first[symbol] + b, mirror + smaller

    def letters(self, match, right: bool):
        """Every match with one more letter: the number of the match, the letter, the new match."""
        low, high, mirror = match
        if right:
            row, symbol, a, b, smaller = self.right.symbols(mirror, mirror + high - low)
            low = low[row] + smaller
            new = low, low + b - a, self.first[symbol] + a
        else:
            row, symbol, a, b, smaller = self.left.symbols(low, high)
            new = self.first[symbol] + a, self.first[symbol] + b, mirror[row] + smaller
        some = np.flatnonzero(symbol > DELIMITER)
        return row[some], symbol[some], tuple(x[some] for x in new)

    def near(self, asked: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of asked words and of the words of the block that are one edit away.

        The edit is in the right half, or in the left half, as ``right`` says.
        """
        sizes = np.array([len(w) for w in asked], dtype=np.int64)
        halves = sizes // 2 if right else sizes - sizes // 2
        coded = self.encode("".join(w if right else w[::-1] for w in asked))
        coded = np.append(coded, self.absent)  # a word may end where it is read
        begin = np.cumsum(sizes) - sizes

        query, match = np.arange(len(asked)), self.start(len(asked))
        for place in range(int(halves.max(initial=0))):
            going = place < halves[query]
            symbol = np.where(going, coded[begin[query] + np.minimum(place, sizes[query] - 1)], 0)
            more = self.extend(match, symbol, right)
            match = tuple(np.where(going, new, old) for new, old in zip(more, match))
            query, match = _found(query, match)
        place = halves[query]

        # Matches without an error, and those with one; each round takes in one symbol.
        states = (query, place, *match)
        wrong = tuple(x[:0] for x in states)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(states[0]) or len(wrong[0]):
            wrong = self._follow(wrong, sizes, begin, coded, right, hits)
            query, place, *match = states
            inside = place < sizes[query]
            symbol = np.where(inside, coded[begin[query] + place], 0)
            following = np.where(
                place + 1 < sizes[query], coded[np.minimum(begin[query] + place + 1, len(coded) - 1)], 0
            )
            new = [wrong]
            # The asked word's symbol is left out; of equal ones the last.
            some = np.flatnonzero(inside & (symbol != following))
            new.append((query[some], place[some] + 1, *(x[some] for x in match)))
            row, letter, more = self.letters(tuple(match), right)
            differs = letter != symbol[row]
            # Another symbol in its place, or one more before it; of equal ones the last.
            some = np.flatnonzero(differs & inside[row])
            new.append((query[row][some], place[row][some] + 1, *(x[some] for x in more)))
            some = np.flatnonzero(differs)
            new.append((query[row][some], place[row][some], *(x[some] for x in more)))
            wrong = tuple(np.concatenate(parts) for parts in zip(*new))
            some = np.flatnonzero(inside)
            query, place, symbol = query[some], place[some], symbol[some]
            more = self.extend(tuple(x[some] for x in match), symbol, right)
            alive = np.flatnonzero(more[1] > more[0])
            states = (query[alive], place[alive] + 1, *(x[alive] for x in more))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.concatenate([q for q, _ in hits]) * self.rows + np.concatenate([w for _, w in hits])
        return np.divmod(np.unique(found), self.rows)

    def _follow(self, states, sizes, begin, coded, right: bool, hits: list):
        """Take in the next symbol where the error is spent, or the delimiter that ends the word."""
        query, place, *match = states
        inside = place < sizes[query]
        symbol = np.where(inside, coded[begin[query] + place], DELIMITER)
        more = self.extend(tuple(match), symbol, right)
        alive = more[1] > more[0]
        done = np.flatnonzero(alive & ~inside)
        if len(done):
            # Row 0 is the delimiter behind the last word; a word's row is its place after it.
            hits.append((query[done], more[0][done] - 1))
        going = np.flatnonzero(alive & inside)
        return (query[going], place[going] + 1, *(x[going] for x in more))


def _found(query: np.ndarray, match) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    alive = np.flatnonzero(match[1] > match[0])
    return query[alive], tuple(x[alive] for x in match)


# Links ---------------------------------------------------------------------------------------

LEFT, RIGHT = "L", "R"
FOUND = "word string, n long, n_near long, form string, form_n long"


def _asks(word: str) -> tuple[str, str]:
    half = len(word) // 2
    return LEFT + word[:half], RIGHT + word[half:]


def _lies(word: str) -> set[str]:
    """Halves that are left as they are in a word of nearly the same length."""
    sizes = [n for n in (len(word) - 1, len(word), len(word) + 1) if n >= LEAST_LENGTH]
    return {LEFT + word[: n // 2] for n in sizes} | {RIGHT + word[-(n - n // 2) :] for n in sizes}


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, asking, rows = [], [], []
        for at, word in enumerate(batch.column("word").to_pylist()):
            lies, asks = _lies(word), _asks(word)
            keys += [*lies, *asks]
            asking += [False] * len(lies) + [True] * len(asks)
            rows += [at] * (len(lies) + len(asks))
        taken = batch.select(["word", "n"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(asking, pa.bool_()), *taken.columns],
            names=["half", "asks", "word", "n"],
        )


class _Block:
    """Words that lie in some halves, and words that ask there."""

    def __init__(self):
        self.counts: dict[str, int] = {}
        self.index: BidirectionalIndex | None = None
        self.asks: list[tuple[str, str, int, int, int]] = []

    def add(self, word: str, n: int) -> None:
        if word not in self.counts:
            self.counts[word] = n
            self.index = None

    def answers(self) -> Iterator[pa.RecordBatch]:
        """One row per asking word that has near words here; the asks are done then."""
        asks, self.asks = self.asks, []
        if not asks or len(self.counts) < 2:
            return
        if self.index is None:
            self.index = BidirectionalIndex(list(self.counts))
        for side in (LEFT, RIGHT):
            mine = [a for a in asks if a[0] == side]
            for at in range(0, len(mine), TOGETHER):
                yield self._search(mine[at : at + TOGETHER], side == LEFT)

    def _search(self, asks: list[tuple[str, str, int, int, int]], right: bool) -> pa.RecordBatch:
        words = self.index.words
        rows: dict[int, list] = {}
        for q, w in zip(*(x.tolist() for x in self.index.near([a[1] for a in asks], right))):
            _, word, n, block, blocks = asks[q]
            other = words[w]
            if blocks > 1 and zlib.crc32(other.encode()) % blocks != block:
                continue  # it lies in another block of this half
            if not right and other.startswith(word[: len(word) // 2]):
                continue  # both halves are shared
            m = self.counts[other]
            row = rows.setdefault(q, [word, n, 0, other, m])
            row[2] += 1
            if m > row[4] or (m == row[4] and other < row[3]):
                row[3], row[4] = other, m
        columns = list(zip(*rows.values())) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["word", "n", "n_near", "form", "form_n"],
        )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of half and block, the words that lie there before those that ask."""
    block, group = _Block(), None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("half", "block", "blocks", "asks", "word", "n")))
        for half, part, parts, asks, word, n in rows:
            if (half, part) != group:
                group = half, part
                if max(len(block.counts), len(block.asks)) >= BLOCK:
                    yield from block.answers()
                    block = _Block()
            if not asks:
                block.add(word, n)
                continue
            block.asks.append((half[0], word, n, part, parts))
            if len(block.asks) >= 2 * BLOCK:
                yield from block.answers()
    yield from block.answers()


def near_words(words: DataFrame) -> DataFrame:
    """Partial results of words (word, n): n_near, and the near word of largest count."""
    entries = words.select("word", "n").mapInArrow(
        _halves, "half string, asks boolean, word string, n long"
    )
    large = (
        entries.where(~F.col("asks"))
        .groupBy("half")
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
        .where(F.col("blocks") > 1)
    )
    sized = entries.join(large, "half", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array((F.crc32("word") % F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = sized.withColumn("block", F.explode(F.when(F.col("asks"), every).otherwise(own)))
    ordered = dealt.repartition("half", "block").sortWithinPartitions("half", "block", "asks")
    return ordered.mapInArrow(_search, FOUND)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: where the chain of forms ends, by pointer jumping."""
    links = written(
        forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "links"
    )
    for _ in range(JUMPS):
        beyond = links.select(F.col("word").alias("_via"), F.col("root").alias("_beyond"))
        met = links.join(beyond, links["root"] == beyond["_via"], "left")
        jumped = written(
            met.select(
                "word",
                F.coalesce("_beyond", "root").alias("root"),
                F.col("_beyond").isNotNull().alias("moved"),
            ),
            "links",
        )
        links = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return links


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs, key, text), "words")
    own = words.select(
        "word",
        "n",
        F.lit(0).cast("long").alias("n_near"),
        F.lit(None).cast("string").alias("form"),
        F.lit(None).cast("long").alias("form_n"),
    )
    # The best form is the smallest pair of negated count and word; without a form both are NULL.
    best = F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form"))
    merged = own.union(near_words(words)).groupBy("word", "n").agg(
        F.sum("n_near").alias("n_near"), F.min(best).alias("best")
    )
    stands = -F.col("best.m") >= F.col("n") * RATIO
    forms = written(
        merged.select(
            "word",
            "n",
            "n_near",
            F.when(stands, F.col("best.form")).alias("form"),
            F.when(stands, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    found = forms.join(roots(forms), "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def sql() -> str:
    """The results of the query for DuckDB."""
    upper = "".join(map(chr, _LOWER))
    return f"""
WITH RECURSIVE shifted(i, k, v) AS (
    SELECT i, 0, i FROM range(256) t(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, {0xEDB88320}) ELSE v >> 1 END
    FROM shifted WHERE k < 8
), checksums AS (
    SELECT list(v ORDER BY i) AS entries FROM shifted WHERE k = 8
), runs AS (
    SELECT doc_id, translate(run, '{upper}', '{upper.lower()}') AS run, count(*) AS n
    FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
                 unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    GROUP BY ALL
), coded AS (
    SELECT run, n, xor({0xFFFFFFFF}, list_reduce(
               list_prepend({0xFFFFFFFF}::BIGINT, list_transform(
                   range(1, octet_length(encode(doc_id || ':' || run)) + 1),
                   lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i::INT - 1, 2))::BIGINT)),
               lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1]))) AS h
    FROM runs, checksums
), words AS (
    SELECT CASE WHEN h % {LOSES} = 0
                THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                ELSE run END AS word,
           sum(n)::BIGINT AS n
    FROM coded GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND sum(n) >= {LEAST_COUNT}
), variants AS (
    SELECT word, n, i AS place, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), links AS (
    SELECT a.word, b.word AS near, b.n AS near_n
    FROM variants a JOIN variants b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM variants a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM variants a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near,
           max(near_n) AS near_n
    FROM links GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
           CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form,
           CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
), chains(word, reached, depth) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL
    SELECT c.word, f.form, depth + 1 FROM chains c JOIN forms f ON c.reached = f.word
    WHERE f.form IS NOT NULL
), roots AS (
    SELECT word, arg_max(reached, depth) AS root FROM chains GROUP BY word
)
SELECT f.word, f.form, r.root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM forms f JOIN roots r ON f.word = r.word
"""
