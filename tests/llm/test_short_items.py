"""Benchmark items without a usable template window, and text ids."""

from tidelake.llm import decontamination as D
from tidelake.llm.common import prepare

ITEMS = [
    (1, "Anna Bob Carl Dora Emil Fred Gina Hugo"),
    (2, "世界上最高的山峰是哪一座山峰呢？"),
    (3, "12 + 34 = 46, 56 + 78 = 134"),
    (4, "2 + 2 = ?"),
    (5, "Name the capital of France"),
    (6, "What is the name of the river that runs through the old town of Bremen?"),
    (7, "?!"),
    (8, None),
]
CLEAN = "Some plain text that has nothing to do with any of these items but 12 and 34 and Anna and Bob."


def leaked(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.leaks(docs, bench)
    assert dict(rows.dtypes)["doc_id"] == "string" and dict(rows.dtypes)["item_id"] == "bigint"
    return {(r["doc_id"], r["item_id"]) for r in rows.collect()}


def test_items_without_windows_are_found_as_exact_copies(spark):
    prepare(spark)
    texts = {
        "names": f"{CLEAN} Anna Bob Carl Dora Emil Fred Gina Hugo {CLEAN}",
        "cjk": "前面的文字世界上最高的山峰是哪一座山峰呢？后面的文字",
        "sums": f"{CLEAN}\n12 + 34 = 46, 56 + 78 = 134\n{CLEAN}",
        "line": f"{CLEAN}\n 2 + 2 = ? \n{CLEAN}",
        "clean": CLEAN,
        "part": f"{CLEAN} 22 Anna Bob Carl Dora Emil 世界上最高的",
        "empty": "",
        "short": "Name the capital of France",
        "nothing": None,
    }
    assert leaked(spark, texts) == {("names", 1), ("cjk", 2), ("sums", 3), ("line", 4), ("short", 5)}


def test_first_word_behind_a_line_feed_or_a_colon(spark):
    prepare(spark)
    item = [(6, "What is the name of that big river there")]
    texts = {
        "feed": f"a heading without a stop\n{item[0][1]}\nmore",
        "colon": f"and then Q: {item[0][1]} and more",
        "other": "what was the name of this small river there",
    }
    assert leaked(spark, texts, item) == {("feed", 6), ("colon", 6)}


def test_no_exact_search_without_such_items(spark):
    """Only the sizes that the benchmark has are looked for."""
    prepare(spark)
    long = [(6, ITEMS[5][1])]
    assert leaked(spark, {"a": f"{CLEAN} {ITEMS[5][1]}", "b": ITEMS[0][1]}, long) == {("a", 6)}
    assert leaked(spark, {"a": CLEAN}, [(7, "?!"), (8, None)]) == set()


def test_exact_windows_against_slices():
    text = "Ab, c\nDé f-123 世界 xyz" * 3
    plain = "".join(c for c in text.lower() if c.isalnum())
    assert D.said(text) == plain
    hashes = D.exact_windows(text)
    assert len(hashes) == len(plain) - D.CHARS + 1
    by_slice = {}
    for i, h in enumerate(hashes.tolist()):
        by_slice.setdefault(plain[i : i + D.CHARS], set()).add(h)
    assert all(len(x) == 1 for x in by_slice.values())
    assert len(set(hashes.tolist())) == len(by_slice)
