"""The operators against brute force, round trips, held-out accuracy and small cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidelake.llm import decontamination, html_text, language_id, pieces, secrets, simhash, suffix_tree
from tidelake.llm.common import prepare, read
from tidelake.llm.components import components
from tidelake.llm.registry import PIECES, QUERIES

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts(spark, sf):
    prepare(spark)
    return {r["doc_id"]: r["text"] for r in read(spark, sf, "documents").select("doc_id", "text").collect()}


# 1: secrets


def base_spans(text):
    found = []
    rule = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(rule, text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


def test_secret_query(spark):
    prepare(spark)
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in read(spark, sf, "documents").collect()}
    rows = QUERIES["op1_secret_scans"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [
            sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")
        ]
        assert set(want) <= set(r["spans"].split(","))
    assert any(r["n_assign"] for r in rows)


def entropy(run):
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def test_windows_match_direct_entropy():
    rng = random.Random(3)
    for _ in range(300):
        run = "".join(rng.choice("abcdef0123456789ABC"[: rng.randint(2, 19)]) for _ in range(rng.randint(1, 70)))
        hot = set()
        for i in range(len(run) - secrets.WINDOW + 1):
            if entropy(run[i : i + secrets.WINDOW]) >= 3.0 - 1e-12:
                hot |= set(range(i, i + secrets.WINDOW))
        got = {k for b, e in secrets.hot_windows(run, 3.0) for k in range(b, e)}
        assert got == hot


def test_entropy_spans_and_allow_list():
    key = "Zk3vQ9xB7Lr2TnW8yHc4Ms6P"
    text = f"Set it to {key} now. ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"
    start = text.index(key)
    assert secrets.spans_of(text) == [(start, secrets.KINDS.index("entropy_base64"), start + len(key))]
    assert secrets.masked(text) == text.replace(key, secrets.MASK)
    for fine in (
        "internationalization-and-localization-of-words",
        "123e4567-e89b-12d3-a456-426614174000",
        f"https://host.example/x/{key}",
        "12345678901234567890",
        "Menteosciónmenteosciónmenteosadorado",
    ):
        assert secrets.spans_of(fine) == []
    assert secrets.masked('a token = "769b0074ad8f3a10fee0689c8d788a140298285a" b') == 'a [SECRET]" b'


# 2: near-duplicates


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64(s.encode(), seed=42).intdigest() >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    array = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.nonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3)[0] + i + 1:
            parent[find(i)] = find(int(j))
    return [find(i) for i in range(len(prints))]


def test_simhash_query(spark, sf, texts):
    rows = QUERIES["op2_simhash_near_dedup"](spark, sf).collect()
    prints = [fingerprint(texts[r["doc_id"]]) for r in rows]
    assert [r["fingerprint"] for r in rows] == [format(p, "016x") for p in prints]
    roots = brute_components(prints)
    least = {}
    for root, r in zip(roots, rows):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in rows] == [least[root] for root in roots]


def test_links_reach_every_distance(spark):
    """Random clusters: chains of one to three flipped bits, in one block and in several."""
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            prints.add(p)
            near = rng.randint(0, 1) * rng.randint(0, 58)
            spots = range(near, near + 5) if near else range(64)
            for b in rng.sample(spots, rng.randint(1, 4)):
                p ^= 1 << b
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    root = {r["node"]: r["root"] for r in found}
    got, want = {}, {}
    for (s,), r in zip(signed, brute_components(prints)):
        got.setdefault(root.get(s, s), set()).add(s)
        want.setdefault(r, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = components(edges.union(spark.createDataFrame([(900, 901), (5, 5)], "u long, v long"))).collect()
    assert {r["root"] for r in rows if r["node"] <= 200} == {0}
    assert {(r["node"], r["root"]) for r in rows if r["node"] > 200} == {(900, 900), (901, 900)}


# 3: pages


@pytest.mark.parametrize(
    "html, want",
    [
        ("<nav>Go</nav><article><h1>T</h1><p>One,  two.\n<p><b>Three</b> four.</article><footer>f</footer>", "T\nOne, two.\nThree four."),
        ("<div class='header'>Menu, x.</div><div id=main><p>Real text, with marks.</p><p>Ok.</p>"
         "<div class=comments><p>I like it, really. Yes.</p></div></div><div class=sidebar><p>More.</p></div>", "Real text, with marks.\nOk."),
        ("<article><p>a &lt;b&gt; &amp; c<script>x='</p>'</script><!-- no --></p><aside>s</aside></article>", "a <b> & c"),
        ("<article><p>cut off in a tag</p><p cla", "cut off in a tag"),
        ("<article><p>x < y and z</p></article>", "x < y and z"),
        ("no markup", "no markup"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_page_query_matches_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in read(spark, sf, "pages").collect()}
    from html import unescape

    for r in QUERIES["op3_html_extraction"](spark, sf).collect():
        article = re.search("<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)
        inner = re.sub("<[a-z/][^>]*$", "", article[1]) if article else ""
        blocks = re.split("</?(?:p|h1|br)>", re.sub("</?b>", "", inner))
        want = [" ".join(unescape(b).split()) for b in blocks]
        assert r["text"] == "\n".join(b for b in want if b)
        assert r["n_chars"] == len(r["text"])


# 4: language model


def test_base_scores(spark, sf, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    words = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    counts = Counter(w for i in texts if not held[i] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op4_lm_scoring"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert r["base_score"] == pytest.approx(base, rel=1e-12)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_tree_is_a_distribution(spark):
    """Under every state the chances of all known words and the unknown one sum to one."""
    rng = random.Random(1)
    lines = [("a b c d " * rng.randint(1, 5) + " ".join(rng.choices("abcdefgh", k=20)),) for _ in range(60)]
    docs = spark.createDataFrame(lines, "text string")
    tree, counts = suffix_tree.learn(docs)
    assert len(tree.states[0][0]) and len(tree.states[1][0])
    hashes = [r["word"] for r in counts.collect()]
    names = {suffix_tree._hash(w): w for w in [*(c.encode() for c in "abcdefgh"), suffix_tree.END]}
    words = [names[h] for h in hashes]
    places = suffix_tree.Places(tree.head)
    for context in ([], [b"a"], [b"a", b"b"], [b"c", b"d"], [b"h", b"a"]):
        total = 0.0
        for w in [*words, b"unknown"]:
            at = places.of([*context, w])
            chance, left = suffix_tree._log_chances(tree, at)
            if at[-1] < 0:
                total += math.exp(left[-1]) * float(tree.root(np.array([0]))[0])
            else:
                total += math.exp(chance[-1])
        assert total == pytest.approx(1.0, abs=1e-9)


# 5: decontamination


def test_leaks_and_changed_questions(spark):
    prepare(spark)
    item = "If Alice has 3 apples and Bob gives Alice 5 more apples on Monday, how many apples does Alice have at the end?"
    changed = item.replace("Alice", "Carol").replace("3", "7").replace("5", "11")
    broken = "If Carol has 3 apples and Dave gives Erin 5 more apples on Monday, how many apples does Frank have at the end?"
    docs = [
        (1, "Before it. " + item + " After it."),
        (2, "before it " + changed + " after it"),
        (3, "Nothing of that kind is here, only some words about apples and days."),
        (4, broken),
    ]
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    rows = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    got = {r["doc_id"]: r for r in rows}
    assert set(got) == {1, 2}
    assert got[1]["n_changed"] == 0 and got[2]["n_changed"] >= 2 and got[2]["n_conflicts"] == 0


def test_leak_query(spark, sf, texts):
    items = {r["item_id"]: r["text"] for r in read(spark, sf, "benchmark").collect()}
    want = set()
    for i, text in texts.items():
        for j, item in items.items():
            words = item.split()
            if any(" ".join(words[k : k + 8]) in (text or "") for k in range(max(1, len(words) - 7))):
                want.add((i, j))
    rows = QUERIES["op5_benchmark_decontamination"](spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and want


# 8 and 9: held-out accuracy


def test_language_accuracy(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in read(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = QUERIES["op8_language_id"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and len(held) > 20
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_codewords_split_and_differ():
    for n in (2, 3, 4, 6, 9):
        codes = language_id.codewords(n)
        assert (abs(codes.sum(axis=0)) < n).all()
        assert len({tuple(row) for row in codes.tolist()}) == n


def test_classifier_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in read(spark, sf, "labels").collect()}
    rows = QUERIES["op9_quality_classifier"](spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = [r["score"] for r in held if labels[r["doc_id"]] == 1]
    bad = [r["score"] for r in held if labels[r["doc_id"]] == 0]
    assert np.mean([[g > b for g in good] for b in bad]) >= 0.9
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)


# 10: pieces


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path(PIECES), "rb") as f:
        return pieces.MergeVocabulary(f.read())


def test_piece_query(spark, sf, texts, vocabulary):
    rows = QUERIES["op10_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(texts) and all(r["agrees"] for r in rows)
    for r in rows:
        ids = vocabulary.library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        decoded = vocabulary.library.decode(ids)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_pieces_against_the_library(vocabulary):
    rng = random.Random(1)
    alphabet = "ab ▁\n\t\r é€😀<s></s>​�xyzthe 0\x00\x01   漢字"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = vocabulary.library.encode(text, add_bos=True, add_eos=True)
        assert vocabulary.encode(text) == ids
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, *range(3, 300), 29871]) for _ in range(rng.randint(0, 8))]
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


def test_both_merges_agree(vocabulary):
    rng = random.Random(2)
    units = {"▁" * rng.randint(0, 3) + "".join(rng.choices("thesonrain", k=rng.randint(1, 20))) for _ in range(500)}
    vocabulary.learn(units)
    assert all(vocabulary.known[u] == vocabulary.merge(u) for u in units)


# pipeline


def test_pipeline_rows(spark, sf, texts):
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert out and out <= set(texts)
    docs = read(spark, sf, "documents")
    for (_, stage), _ in zip(corpus_pipeline.STAGES, range(3)):
        docs = stage(spark, docs, sf)
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == out
