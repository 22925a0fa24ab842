"""SimHash, suffix arrays, sharding and components against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import DOCS, components, corpus, fingerprint, words
from tidemark.llm import sharding, simhash, suffix
from tidemark.llm.components import connected_components, local_labels


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(2)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 120, (90, 2))] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(900, 930)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(1000, pairs)
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    i, j = (np.array([p[k] for p in pairs]) for k in (0, 1))
    assert local_labels(1000, i, j).tolist() == want


def test_simhash_against_brute_force(spark):
    rows = corpus()
    prints = [fingerprint(r[1]) for r in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    comp = components(len(rows), pairs)
    ids = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    want = sorted((r[0] if r[0] is not None else -1, f"{p:016x}", ids[c] if ids[c] is not None else -1) for r, p, c in zip(rows, prints, comp, strict=True))
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.components_of(frame(spark, rows)).collect()]
    assert sorted((a if a is not None else -1, f, c if c is not None else -1) for a, f, c in got) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_lose_no_link_and_hot_buckets_are_cut(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    prints = {int(b) for b in base}
    for b in base[:3]:
        for _ in range(60):
            flips = rng.choice(63, rng.integers(1, 5), replace=False)
            prints.add(int(b) ^ sum(1 << int(f) for f in flips))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "PLAN_SHARE", 1)
    nodes = spark.createDataFrame([(p, p) for p in prints], "node long, _f0 long")
    edges = [(r["a"], r["b"]) for r in simhash.fingerprint_links(nodes, 1, 4, 3).collect()]
    at = {p: k for k, p in enumerate(prints)}
    want = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert components(len(prints), [(at[a], at[b]) for a, b in edges]) == want


def test_keep_one_leaves_one_of_each_group(spark):
    rng = random.Random(5)
    base = words(rng, 300, 10**6)
    rows = [(k, words(rng, 200, 10**6)) for k in range(10)] + [(20, base), (21, base)]
    for k in range(30, 36):
        w = base.split()
        w[rng.randrange(300)] = "changed"
        rows.append((k, " ".join(w)))
    rows += [rows[0], (None, words(rng, 50, 10**6)), (40, None), (41, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(k for k in kept if k is not None) == [*range(10), 20, 40]
    assert kept.count(None) == 1
    assert simhash.keep_one(df.limit(0)).count() == 0


def brute_spans(rows, length=50):
    seen, out, done = set(), {}, set()
    key = lambda r: (r[0] is not None, r[0] or 0)
    for r in sorted(rows, key=key):
        w = (r[1] or "").encode().split()
        if r in done:
            continue
        done.add(r)
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            if k in seen:
                gone[s : s + length] = [True] * length
            seen.add(k)
        out[r[0], r[1]] = gone
    return out


def test_repeats_against_brute_force(spark):
    rows = corpus()
    got = suffix.remove_repeats(frame(spark, rows))
    want = brute_spans(rows)
    seen = 0
    originals = {r[0]: r[1] for r in rows}
    for r in got.collect():
        gone = want[r["doc_id"], originals[r["doc_id"]]]
        mine = [False] * len(gone)
        for s in r["_spans"]:
            mine[s["from"] : s["to"]] = [True] * (s["to"] - s["from"])
        assert mine == gone, r["doc_id"]
        left = [w for w, g in zip((originals[r["doc_id"]] or "").split(), gone, strict=True) if not g]
        assert (r["text"] or "").split() == left
        assert r["n_chars"] is None or r["n_chars"] == len(r["text"] or "")
        seen += sum(gone)
    assert seen > 100
    assert got.count() == len(rows)
    assert suffix.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_passage_at_every_offset_is_found(spark):
    rng = random.Random(9)
    rows = []
    for k in range(20):
        p = words(rng, 50, 10**6)
        rows += [(2 * k, words(rng, k) + " " + p + " " + words(rng, 20)), (2 * k + 1, words(rng, 20 - k) + "\n" + p)]
    out = {r["doc_id"]: r["_spans"] for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not out[2 * k] for k in range(20))
    assert all([s["to"] - s["from"] for s in out[2 * k + 1]] == [50] for k in range(20))


def smallest(sizes, shards):
    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while lo < hi:
        mid, used, held = (lo + hi) // 2, 1, 0
        for s in sizes:
            if held + s > mid:
                used, held = used + 1, 0
            held += s
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_capacity_is_minimal_at_any_refinement(spark, bits, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 64)
    rng = random.Random(bits)
    groups = [(k, rng.choice([1, 5, 40, 300])) for k in sorted({rng.getrandbits(63) for _ in range(400)})]
    df = spark.createDataFrame(groups, "key long, bytes long").cache()
    capacity, cuts = sharding.cuts_of(df, 7, bits)
    assert capacity == smallest([b for _, b in groups], 7)
    held = defaultdict(int)
    for k, b in groups:
        held[sum(k >= c for c in cuts)] += b
    assert max(held.values()) == capacity and len(held) <= 7


def test_shards_hold_groups_and_number_slots(spark):
    rows = corpus()
    out = sharding.shard_by_bytes(frame(spark, rows), 6).collect()
    assert len(out) == len(rows)
    slots, by_text, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    text = {r[0]: r[1] for r in rows}
    for r in out:
        slots[r["shard"]].append(r["slot"])
        by_text[text[r["doc_id"]]].add(r["shard"])
        raw = text[r["doc_id"]]
        assert r["size"] == len((raw or "").encode()) + 16
        assert r["text_crc32"] == zlib.crc32((raw or "").encode())
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    key = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:16], 16) >> 1 if t is not None else 0
    total = defaultdict(int)
    for r in rows:
        total[r[1]] += len((r[1] or "").encode()) + 16
    assert max(sizes.values()) == smallest([total[t] for t in sorted(total, key=key)], 6)
    assert sharding.shard_by_bytes(frame(spark, rows).limit(0)).count() == 0
