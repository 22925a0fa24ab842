"""Exact copies of several ids keep their passages apart where rows of null ids share a batch with them."""

from __future__ import annotations

import random

from tests.llm.helpers import words
from tests.llm.test_copies import brute_spans
from tidemark.llm import suffix


def test_copies_are_cut_beside_a_repeated_null_id(spark):
    rng = random.Random(8)
    copy, long = words(rng, 100, 10**6), words(rng, 4000, 10**6)
    rows = [(5, copy), (9, copy), (9, copy), (20, long[: len(long) // 2]), (None, long), (None, long), (30, words(rng, 80, 10**6))]
    want = brute_spans(rows)
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {5: copy, 9: copy, None: long, 20: rows[3][1], 30: rows[6][1]}
    for r in got.collect():
        mine = [False] * r["_words"]
        for s in r["_spans"]:
            mine[s["from"] : s["to"]] = [True] * (s["to"] - s["from"])
        assert mine == want[r["doc_id"], texts[r["doc_id"]]], r["doc_id"]
    assert all(want[9, copy]) and not any(want[5, copy])
