"""Fill-in-middle against brute force, exact round trips, and the boundary set by itself."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidelake.llm import fill_middle as fim
from tidelake.llm.common import prepare, read
from tidelake.llm.registry import QUERIES

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_query_against_brute_force(spark):
    prepare(spark)
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in read(spark, sf, "documents").collect()}
    rows = QUERIES["op13_fill_in_middle"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        *want, output = brute(r["doc_id"], texts[r["doc_id"]])
        assert [r[c] for c in ("n", "form", "prefix_chars", "middle_chars")] == want
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def offsets(kind, rng):
    if kind == "sparse":
        return sorted(rng.sample(range(400_000), 900))
    if kind == "dense":
        return sorted(rng.sample(range(200_000), 120_000))
    if kind == "runs":
        return [i for s in range(0, 300_000, 1000) for i in range(s, s + rng.randint(1, 900))]
    return sorted({0, 1, 65_535, 65_536, 131_071, 1 << 20, *range(65_500, 65_600)})


@pytest.mark.parametrize("kind", ["sparse", "dense", "runs", "edges"])
def test_boundary_set_selects_like_a_list(kind):
    rng = random.Random(kind)
    values = offsets(kind, rng)
    held = fim.BoundarySet(np.array(values, dtype=np.int64))
    assert len(held) == len(values)
    places = range(len(values)) if len(values) < 3000 else rng.sample(range(len(values)), 3000)
    for k in [*places, 0, len(values) - 1]:
        assert held.select(k) == values[k]
    for k in rng.sample(range(len(values)), 100):
        assert held.rank(values[k]) == k and held.rank(values[k] + 1) == k + 1


def test_every_container_is_used():
    rng = random.Random(0)
    kinds = {
        kind: {type(c) for c in fim.BoundarySet(np.array(offsets(kind, rng))).containers}
        for kind in ("sparse", "dense", "runs")
    }
    assert kinds["sparse"] == {fim.ArrayContainer}
    assert fim.BitmapContainer in kinds["dense"]
    assert kinds["runs"] == {fim.RunContainer}


def test_cuts_of_long_texts():
    rng = random.Random(4)
    for unit in ("a ", "word  ", "\t", "x", "é😀 \n"):
        text = unit * 90_000 + "end "
        tokens = TOKEN.findall(text)
        for _ in range(20):
            one, two = rng.getrandbits(32), rng.getrandbits(32)
            a, b = sorted((one % (len(tokens) + 1), two % (len(tokens) + 1)))
            want = len(tokens), len("".join(tokens[:a])), len("".join(tokens[:b]))
            assert fim.cut(text, one, two) == want


def test_round_trip_of_parts_that_end_like_marks():
    for text in ("a <S b <P c <", "<<P <S <M >", "P> S> M>", "< P > <"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for form in (fim.PSM, fim.SPM, fim.PLAIN):
                    assert fim.rebuilt(fim.joined(text, form, a, b), form) == text


def test_defined_cases(spark):
    prepare(spark)
    schema = "doc_id long, text string, n string, output string, _text string, `a.b` string"
    clash = ("n", "o", "t", "d")
    texts = [(i, f"  some words of text {i}  and more \n") for i in range(40)]
    texts += [(1, texts[1][1]), (None, "a b c d"), (None, None), (50, None), (51, ""), (52, " \t")]
    texts += [(i, "has <S> in it") for i in range(60, 70)] + [(70, "word " * 60_000)]
    docs = spark.createDataFrame([(*t, *clash) for t in texts], schema)
    made = fim.fill_middle(docs)
    assert made.columns == ["doc_id", "text", "_text", "a.b", *fim_columns()]
    made = made.withColumn("_back", fim.restored("output", "form")).collect()
    assert len(made) == len(texts)
    for r in made:
        assert tuple(r[c] for c in fim_columns()) == brute(r["doc_id"], r["text"])
        assert r["_back"] == (r["text"] or "")
    assert fim.fill_middle(docs.limit(0)).collect() == []


def fim_columns():
    return ["n", "form", "prefix_chars", "middle_chars", "output"]
