"""The language model scores the same whatever part of it is cached."""

import pytest

from tidelake.llm import suffix_tree
from tidelake.llm.registry import QUERIES


def test_scores_do_not_depend_on_the_cache(spark, sf, monkeypatch):
    """A larger corpus raises the cache's least count; the model must not change with it."""

    def run():
        rows = QUERIES["op4_lm_scoring"](spark, sf).collect()
        return {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in rows}

    want = run()
    for entries in (2000, 50, 1):
        monkeypatch.setattr(suffix_tree, "RESOLUTION", entries)
        got = run()
        assert got.keys() == want.keys()
        for key, values in want.items():
            assert got[key] == pytest.approx(values, rel=1e-9)
