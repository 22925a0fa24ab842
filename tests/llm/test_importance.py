"""Importance resampling against its definition, on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.helpers import DOCS, corpus
from tidemark.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None) -> tuple[int, list[bytes]]:
    w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return len(w), w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]


def plain(docs: list[tuple], target: list[str | None], percent: int, least: int, buckets: int) -> list[tuple]:
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features(t)[1])
    s, t = count(d[1] for d in docs), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        n, f = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in (zlib.crc32(x) % buckets for x in f)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(str, rows))


@pytest.mark.parametrize(("percent", "least", "buckets"), [(25, 20, 10_000), (100, 0, 64), (0, 1, 7), (50, 3, 1)])
def test_draw_is_the_defined_one(spark, percent, least, buckets):
    rows = corpus(5)
    rows += [rows[2], rows[2], (901, "Ünï CODE 12 a-b A_B " * 9, *rows[0][2:]), (902, "x" * 100_000 + " y", *rows[0][2:]), (903, "\x00\x7f tab\tnl\n" * 30, *rows[0][2:])]
    target = [None, "", "w1 w2 w3 w4", rows[7][1], "ünï code"]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string"), percent, least, 7, buckets)
    want = plain([r[:2] for r in rows], target, percent, least, buckets)
    assert sorted(str(list(r)) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == want


def test_ties_repeats_and_empty_tables(spark):
    same = [(5, "a " * 30), (5, "a " * 30), (None, "a " * 30), (None, "a " * 30), (2, "b c " * 30)]
    docs = spark.createDataFrame(same, "doc_id long, text string")
    target = spark.createDataFrame([("a",)], "text string")
    ranks = sorted(r["rank"] for r in importance.resample(docs, target, percent=100).collect())
    assert ranks == [1, 2, 3, 4, 5]
    assert importance.resample(docs.limit(0), target).count() == 0
    out = importance.resample(docs, target.limit(0), percent=60).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3]
    clash = docs.selectExpr("doc_id", "text", "'x' AS TEXT", "1 AS score", "2 AS rank", "3 AS Doc_Id")
    assert importance.resample(clash, target).count() == 5


def test_draw_prefers_texts_like_the_target(spark):
    rng = random.Random(8)
    sorts = [[f"{c}{k}" for k in range(200)] for c in "pq"]
    rows = [(k, " ".join(rng.choice(sorts[k % 4 == 0]) for _ in range(60))) for k in range(400)]
    target = spark.createDataFrame([(" ".join(rng.choice(sorts[1]) for _ in range(60)),) for _ in range(40)], "text string")
    drawn = [r["doc_id"] for r in importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).collect() if r["rank"]]
    assert len(drawn) == 100
    assert sum(d % 4 == 0 for d in drawn) > 2 * 25  # a draw by chance alone takes 25 of them


@given(st.lists(st.tuples(st.binary(max_size=30), st.binary(max_size=300)), max_size=20))
def test_crc_of_texts_put_together(pairs):
    left, right = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = importance.joined_crc(left, right, np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
