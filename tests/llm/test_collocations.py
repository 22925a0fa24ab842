"""Phrase collocations against counting every run of words."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import DOCS, corpus
from tidemark.llm import collocations


def plain(rows, top: int, longest: int, least: int) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        frequent = {g: a for g, a in count.items() if a >= least}
        longer = Counter()  # the most occurrences of any longer phrase that holds it
        for h, b in frequent.items():
            for k in range(2, len(h)):
                for i in range(len(h) - k + 1):
                    longer[h[i : i + k]] = max(longer[h[i : i + k]], b)
        found = []
        for g, a in frequent.items():
            if len(g) < 2 or g in longer and 100 * longer[g] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (count[g[:j]] + count[g[j:]]), j, count[g[:j]], count[g[j:]]) for j in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def talk(rng: random.Random, n: int) -> str:
    """Words of few kinds with set phrases, stops and blanks of all sorts, capitals and letters beyond ASCII."""
    sets = ["New York", "en passant", "a b c d e", "ha ha ha ha ha", "École Été", "x\ty"]
    out = []
    for _ in range(n):
        out.append(rng.choice(sets) if rng.random() < 0.4 else rng.choice("abcdeß") * rng.randrange(1, 3))
        out.append(rng.choice([" ", "  ", "\t", ", ", ". ", "\n", " ;", "  ", "\r", " "]))
    return "".join(out)


@pytest.mark.parametrize(("least", "longest", "block"), [(30, 4, 4 << 20), (3, 4, 200), (1, 3, 1), (5, 2, 5000)])
def test_phrases_are_those_of_a_full_count(spark, least, longest, block):
    rng = random.Random(least)
    rows = [(k, talk(rng, rng.randrange(1, 40 if least == 1 else 120)), rng.choice(["en", "de", "und", None])) for k in range(40 if least == 1 else 150)]
    rows += [(900, None, "en"), (901, "", "fr"), (902, " \n.", None), (903, "one", "fr"), (904, "é" * 50_000 + " tail", "fr"), rows[0], rows[0]]
    docs = spark.createDataFrame([(k, lang, text, "X", 1) for k, text, lang in rows], "doc_id long, lang string, text string, TEXT string, id int").repartition(3)
    got = collocations.best_phrases(docs, 50, longest, least, block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain([r[:0:-1][::-1] for r in rows], 50, longest, least)


def test_odd_rows_and_no_rows(spark):
    docs = spark.createDataFrame([*corpus(2), *corpus(2), *corpus(3)], DOCS)
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    assert sorted(map(tuple, collocations.best_phrases(docs, least=2).collect())) == plain(rows, 2000, 4, 2)
    assert collocations.best_phrases(docs.limit(0)).count() == 0
    assert collocations.best_phrases(docs, least=10**9).count() == 0


def test_counts_beyond_64_bits_are_exact(spark):
    a, over = 9_000_000_000_000_000_001, 7_200_000_000_000_000_001
    kinds = "id long, lang string, words array<string>, f long, first long, second long, pre array<long>, suf array<long>"
    one = [(k, "en", [w], 9 * 10**18 + k, None, None, [9 * 10**18 + k], [9 * 10**18 + k]) for k, w in enumerate("abc")]
    two = [(10, "en", ["a", "b"], a - 3, 0, 1, [9 * 10**18, a - 3], [a - 3, 9 * 10**18 + 1]), (11, "en", ["b", "c"], a, 1, 2, [9 * 10**18 + 1, a], [a, 9 * 10**18 + 2])]
    three = [(20, "en", ["a", "b", "c"], over, 10, 11, [9 * 10**18, a - 3, over], [over, a, 9 * 10**18 + 2])]
    got = {r["phrase"]: r["score"] for r in collocations.candidates([spark.createDataFrame(x, kinds) for x in (one, two, three)]).collect()}
    want = {"a b c": min(2_000_000 * over // (9 * 10**18 + a), 2_000_000 * over // (a - 3 + 9 * 10**18 + 2))}
    if 100 * over < 80 * a:
        want["b c"] = 2_000_000 * a // (2 * 9 * 10**18 + 3)
    if 100 * over < 80 * (a - 3):
        want["a b"] = 2_000_000 * (a - 3) // (2 * 9 * 10**18 + 1)
    assert got == want


def test_pairs_are_shuffled_packed(spark, monkeypatch):
    """Each pair is in one part, several times if a task sends often, and takes a few bytes."""
    rng = np.random.default_rng(4)
    blocks, want = [], {}
    for b in range(12):
        ids = np.unique(rng.integers(0, 3000, 900)) + (1 << 33)
        key = rng.integers(0, len(ids), 20_000)
        blocks.append((b, collocations._postings(np.arange(20_000), key, ids)[0]))
        for x, y in zip(ids[key[:-1]].tolist(), ids[key[1:]].tolist(), strict=True):
            want[x, y] = want.get((x, y), 0) + 1
    lists = spark.createDataFrame(blocks, collocations.LISTS).coalesce(2)
    sizes = {}
    for held in (1 << 22, 50_000):
        monkeypatch.setattr(collocations, "HELD", held)
        rows = collocations.pair_counts(lists, 5).collect()
        got, parts = {}, {}
        for r in rows:
            first, second, n = collocations._arrays(bytes(r["pairs"]))
            for pair, k in zip(zip(np.cumsum(first).tolist(), np.cumsum(second).tolist(), strict=True), n.tolist(), strict=True):
                got[pair] = got.get(pair, 0) + k
                parts.setdefault(pair, set()).add(r["part"])
        assert got == want and {len(p) for p in parts.values()} == {1}
        sizes[held] = sum(len(r["pairs"]) for r in rows)
    assert sizes[1 << 22] < 6 * 2 * len(want)
    frequent = {(r["first"], r["second"]): r["f"] for r in collocations.frequent_pairs(lists, 3).collect()}
    assert frequent == {p: k for p, k in want.items() if k >= 3}


def test_a_language_fills_its_blocks(spark):
    """Rows whose languages alternate take as many blocks as their text fills, not one a language and slice."""
    rows = [(k, ["en", "de", "fr", None][k % 4], f"word{k % 7} and some more of it") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    blocks = collocations.word_lists(docs, 1000).collect()
    assert len(blocks) == 4 * 3 and len({b["block"] for b in blocks}) == len(blocks)
    assert {b["lang"] for b in blocks} == {"en", "de", "fr", "und"} and sum(sum(b["counts"]) for b in blocks) == 6 * 400
    many = spark.createDataFrame([(k, f"l{k % 50}", t) for k, _, t in rows], "doc_id long, lang string, text string").coalesce(1)
    blocks = collocations.word_lists(many, 100).collect()
    assert {b["lang"]: 0 for b in blocks} == {f"l{k}": 0 for k in range(50)} and sum(sum(b["counts"]) for b in blocks) == 6 * 400


def test_numbers_go_back_to_their_block_packed(spark, monkeypatch):
    """A block's numbers come back whole in one row, several parts of them if a task sends often, and take a few bytes."""
    rng = np.random.default_rng(5)
    want = {(b << 32) + 3: dict(zip(np.flatnonzero(rng.random(5000) < 0.6).tolist(), (rng.integers(0, 40_000, 5000) + (7 << 33)).tolist(), strict=False)) for b in range(9)}
    rows = [(b, at, k) for b, x in want.items() for at, k in x.items()]
    numbers = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "block long, at long, id long").repartition(3)
    for held in (1 << 22, 2000):
        monkeypatch.setattr(collocations, "HELD", held)
        packed = collocations.packed_numbers(numbers, 4).collect()
        assert held == 2000 or sum(len(r["numbers"]) for r in packed) < 5 * len(rows)
        got = [(r["block"], [np.cumsum(x).tolist() for x in collocations._arrays(bytes(r["found"]))]) for r in collocations.found_by_block(collocations.packed_numbers(numbers, 4)).collect()]
        assert len(got) == 9 and {b: dict(zip(*x, strict=True)) for b, x in got} == want


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_blocks_get_the_numbers_of_their_frequent_pairs(spark, monkeypatch, most):
    """Asked and answered packed: with and without the filter, also if a task sends often, and parts without frequent pairs answer nothing."""
    rng = np.random.default_rng(6)
    blocks, held = [], {}
    for b in range(6):
        ids = np.unique(rng.integers(0, 400, 150)) + (1 << 33)
        key = rng.integers(0, len(ids), 3000)
        blocks.append((b, collocations._postings(np.arange(3000), key, ids)[0]))
        held[b] = sorted(set(zip(ids[key[:-1]].tolist(), ids[key[1:]].tolist(), strict=True)))
    kinds = sorted(set().union(*held.values()))
    number = {kinds[k]: int(k) + (5 << 33) for k in rng.permutation(len(kinds))[: len(kinds) // 3]}
    frequent = spark.createDataFrame([(*p, k) for p, k in number.items()], "first long, second long, id long").repartition(3)
    lists = spark.createDataFrame(blocks, collocations.LISTS).coalesce(2)
    for sent in (1 << 22, 1000):
        monkeypatch.setattr(collocations, "HELD", sent)
        asked = collocations.asked_pairs(lists, None, 4).collect()
        assert sent == 1000 or sum(len(r["asked"]) for r in asked) < 8 * sum(map(len, held.values()))
        numbers = collocations.pair_numbers(lists, frequent, most)
        got = {r["block"]: [np.cumsum(x).tolist() for x in collocations._arrays(bytes(r["found"]))] for r in collocations.found_by_block(numbers).collect()}
        assert {b: dict(zip(*x, strict=True)) for b, x in got.items()} == {b: {at: number[p] for at, p in enumerate(x) if p in number} for b, x in held.items()}
    few = spark.createDataFrame([(*kinds[0], 9)], "first long, second long, id long")
    assert {(r["block"], *(x[0] for x in collocations._arrays(bytes(r["found"])))) for r in collocations.found_by_block(collocations.pair_numbers(lists, few, most)).collect()} == {(b, x.index(kinds[0]), 9) for b, x in held.items() if kinds[0] in x}
