"""Packing: encodings of whole texts, gapless sequences, dominance that costs nothing, few sequences."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, corpus
from tidemark.llm import packing


@cache
def library() -> Tokenizer:
    return Tokenizer.from_file(packing.default_path())


def whole(text: str | None) -> list[int]:
    return library().encode(text or "", add_special_tokens=False).ids


odd = st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　᠎​'’.,!-0123٣éßİǅ中🙂́\x00") + ["'s", "'re", " 's", "<|endoftext|>", "<|endof", "the", " The", "n't", "  "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(odd, max_size=14).map("".join), st.text(max_size=12)), max_size=8))
def test_chunks_are_encoded_as_whole_texts(texts):
    ids, ends = packing.chunked(packing.default_path()).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends)[: len(texts)]] == [whole(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "é", "Straße", "naïve", "x1", "9", ".", ",", "..", "?!", "'", "'s", "’", "…", "-", " ", " ", "\n", "ﬁ", "日本", "Ä"]), max_size=20).map("".join), max_size=6))
def test_words_and_marks_are_encoded_as_whole_texts(texts):
    ids, ends = packing.chunked(packing.default_path()).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends)[: len(texts)]] == [whole(t) for t in texts]


def test_a_given_table_is_encoded_as_whole_texts():
    import pyarrow.parquet

    texts = pyarrow.parquet.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    ids, ends = packing.ChunkedBPE(packing.default_path()).encode(texts)
    assert ids.tolist() == [i for e in library().encode_batch(texts.to_pylist(), add_special_tokens=False) for i in e.ids]
    assert len(ends) == len(texts)


def test_every_kind_of_white_space_between_words():
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [f"ab{a}{b}{c} cd{b}" for a in spaces for b in spaces[:8] + spaces[-3:] for c in ("", " ", "\n")]
    ids, ends = packing.chunked(packing.default_path()).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends)[: len(texts)]] == [whole(t) for t in texts]


def fewest(sizes: list[int], capacity: int) -> int:
    """The fewest bins, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(k: int, bins: tuple[int, ...]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for room in set(bins):
            if room >= sizes[k]:
                b = list(bins)
                b.remove(room)
                go(k + 1, tuple(sorted([*b, room - sizes[k]])))
        go(k + 1, tuple(sorted([*bins, capacity - sizes[k]])))

    go(0, ())
    return best


def histogram(sizes: list[int], capacity: int) -> list[int]:
    return np.bincount(sizes, minlength=capacity + 1).tolist()


def checked(plan: packing.Plan, counts: list[int], capacity: int) -> int:
    """Every piece has one place, nothing overlaps, nothing is left between; the number of sequences."""
    filled = defaultdict(list)
    seen = defaultdict(list)
    for size, first, last, each, base, offset in plan.entries().tolist():
        seen[size] += range(first, last)
        for k in range(last - first):
            filled[base + k // each].append((offset + k % each * size, size))
    assert {s: sorted(v) for s, v in seen.items()} == {s: list(range(n)) for s, n in enumerate(counts) if n}
    for held in filled.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= capacity
    assert len(filled) == plan.sequences
    return len(filled)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_dominance_costs_nothing(sizes):
    counts = histogram(sizes, 20)
    plan = packing.Plan(counts, 20)
    plan.reduce()
    rest = [s for s, n in enumerate(plan.left) for _ in range(n)]
    assert plan.fixed + fewest(rest, 20) == fewest(sizes, 20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=400))
def test_plans_are_whole(sizes):
    counts = histogram(sizes, 30)
    assert checked(packing.planned(counts, 30), counts, 30) >= -(-sum(sizes) // 30)


def test_best_fit_is_that_of_single_pieces():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randrange(1, 41) for _ in range(rng.randrange(1, 300))]
        counts = histogram(sizes, 40)
        plan = packing.Plan(counts, 40)
        plan.best_fit()
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 40) - s)
        assert checked(plan, counts, 40) == len(rooms)


def test_a_plan_does_not_grow_with_the_table():
    rng = random.Random(5)
    shape = [0] + [rng.randrange(0, 9) for _ in range(1024)]
    shape[7] = 5000
    small, large = (packing.planned([n * k for n in shape], 1024) for k in (3, 3_000_000_000))
    assert len(large.entries()) < 20_000
    total = sum(s * n for s, n in enumerate(shape)) * 3
    assert small.sequences <= 1.02 * total / 1024 + 1
    assert large.sequences <= 1.001 * total * 10**9 / 1024


def test_few_sequences_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs).select("length", "sequence_id").collect()
    sizes = sorted((r["length"] for r in rows), reverse=True)
    used = len({r["sequence_id"] for r in rows})
    # no two pieces over half share a sequence; and tokens must fit
    assert used <= 1.01 * max(-(-sum(sizes) // 1024), sum(s > 512 for s in sizes))


@pytest.mark.parametrize("capacity", [1024, 64, 7, 1])
def test_pieces_are_the_documents(spark, capacity):
    rows = [r for r in corpus(4) if capacity > 7 or r[0] is None or r[0] % 9 == 0]
    rows += [rows[1], rows[1], (700, "<|endoftext|> x　\n\n y", *rows[0][2:]), (701, None, *rows[0][2:])]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = packing.pack(docs, capacity).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append([*whole(r[1]), 2])
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    want = defaultdict(list)
    for d, all_ids in texts.items():
        for ids in all_ids:
            head = (len(ids) - 1) % capacity + 1
            cuts = [0, *range(head, len(ids) + 1, capacity)]
            want[d] += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in want.items()}
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in filled.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity


def test_no_documents_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3, 4), (None, None, "y", 5, 6)], "doc_id long, text string, TEXT string, length int, part int")
    assert sorted(r["length"] for r in packing.pack(docs).collect()) == [1, len(whole("a b")) + 1]
    assert packing.pack(docs.limit(0)).count() == 0
