"""The pipeline's SimHash stage against brute-force shingle similarity."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.helpers import components, words
from tidemark.llm import simhash


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(rows):
    sets = [shingles(r[1]) for r in rows]
    comp = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])])
    return sorted(min(rows[k][0] for k in range(len(rows)) if comp[k] == c) for c in set(comp))


def replaced_tail(rng, text, n):
    """The text with its last n words replaced."""
    w = text.split()
    return " ".join(w[: len(w) - n]) + " " + words(rng, n, 10**6)


def kept(spark, rows):
    return sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_texts_below_the_similarity_stay(spark):
    """Half of these pairs, at 0.70 to 0.79, are within 24 bits."""
    rng = random.Random(3)
    rows = []
    for k in range(120):
        text = words(rng, 200, 10**6)
        rows += [(2 * k, text), (2 * k + 1, replaced_tail(rng, text, 23 + k % 10))]
    assert kept(spark, rows) == brute_kept(rows) == list(range(240))


def test_no_pair_at_the_similarity_is_missed(spark, monkeypatch):
    """Pairs of two at 0.80 to 0.82, a passage that all of them hold, hot buckets, and few words."""
    rng = random.Random(6)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    monkeypatch.setattr(simhash, "PLAN_SHARE", 2)
    rows, passage = [], words(rng, 30, 10**6)
    for k in range(250):
        text = passage + " " + words(rng, 170, 10**6)
        rows += [(2 * k, text), (2 * k + 1, replaced_tail(rng, text, 19 + k % 3))]
    for k in range(500, 560, 2):
        text = words(rng, 8 + k % 40, 10**6)
        rows += [(k, text), (k + 1, text + " one")]
    rows += [(600 + k, passage + " " + words(rng, k % 9, 10**6)) for k in range(60)]
    want = brute_kept(rows)
    assert kept(spark, rows) == want
    assert len(want) < 400


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_chains_join_by_links_only(spark, monkeypatch, block):
    rng = random.Random(4)
    monkeypatch.setattr(simhash, "SHINGLES", block)
    rows, text = [], words(rng, 200, 10**6)
    for k in range(20):
        rows.append((k, text))
        text = replaced_tail(rng, text, 4 if k != 10 else 60)
    assert kept(spark, rows) == brute_kept(rows) == [0, 11]


@pytest.mark.parametrize("seed", range(6))
def test_similar_sets_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(3000, rng.integers(1, 60), replace=False) for _ in range(8)]
    sets = [np.zeros(0, np.int64)] * 2
    for _ in range(120):
        x = base[rng.integers(len(base))]
        sets.append(np.unique(np.append(x[rng.random(len(x)) < 0.93], rng.integers(0, 3000, rng.integers(0, 3)))))
    i, j = simhash.similar_sets(sets)
    full = [set(x.tolist()) for x in sets]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if full[a] and full[b] and alike(full[a], full[b])]
    assert all(alike(full[a], full[b]) for a, b in zip(i, j, strict=True))
    assert components(len(sets), list(zip(i.tolist(), j.tolist(), strict=True))) == components(len(sets), pairs)


def test_deletion_variants_find_all_pairs_within_their_bits(spark):
    rng = np.random.default_rng(2)
    prints = []
    for k in range(150):
        bits = rng.integers(0, 2, 128)
        prints.append(bits)
        prints.append(np.where(np.isin(np.arange(128), rng.choice(128, 12 + k % 7, replace=False)), 1 - bits, bits))
    f = np.packbits(np.array(prints, np.uint8), axis=1, bitorder="little").view(np.int64)
    nodes = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(f)], "node long, _f0 long, _f1 long")
    edges = [(r["a"], r["b"]) for r in simhash.fingerprint_links(nodes, 2, 15, 8).collect()]
    far = (np.array(prints)[:, None] != np.array(prints)[None]).sum(2)
    close = [(a, b) for a in range(300) for b in range(a) if far[a, b] <= 15]
    assert len(close) > 50 and components(300, edges) == components(300, close)


def test_deletion_variants_carry_the_stage(spark, monkeypatch):
    """Near copies go by their fingerprints alone; rare shingles are asked only for what is farther apart."""
    rng = random.Random(9)
    rows, asked = [], []
    for k in range(40):
        text = words(rng, 200, 10**6)
        rows += [(2 * k, text), (2 * k + 1, replaced_tail(rng, text, 1))]

    def none(classes, lanes, max_bits, beyond):
        asked.append(beyond)
        return classes.sparkSession.createDataFrame([], "a long, b long")

    monkeypatch.setattr(simhash, "prefix_links", none)
    assert kept(spark, rows) == brute_kept(rows) == list(range(0, 80, 2))
    assert asked == [15]
