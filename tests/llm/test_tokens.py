"""BPE, wavelet shards and mixing."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, corpus
from tidemark.llm import bpe, mixing, wavelet

PATH = bpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["It's we'll I'D don't", "<|endoftext|>abc<|startoftext|>", "aaaa aaaaa aaaaaaa", "ÀÉ Σίσυφος ΣΑΣ", "éa ́x", "日本語 1234 ½ ٣", "a b c\x1cd\x85e", "🙂🙂👍🏽!!", "İstanbul", "'sS'tT'reRE'll", "\x00\x01", "a" * 3000]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    e = bpe.load(PATH)
    got = e.encode(pa.array([*ODD, None, ""]))
    assert got.to_pylist() == [ids_of(t) for t in [*ODD, None, ""]]
    assert e.decode(got).to_pylist() == [LIBRARY.decode(i, skip_special_tokens=False) for i in got.to_pylist()]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encoder_equals_the_library_on_any_text(text):
    assert bpe.load(PATH).encode(pa.array([text])).to_pylist() == [ids_of(text)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abthe 'n", max_size=30), max_size=5))
def test_memory_changes_nothing(texts):
    e = bpe.load(PATH)
    memory = bpe.WordIds()
    for _ in range(2):
        assert e.encode(pa.array(texts, pa.string()), memory).to_pylist() == [ids_of(t) for t in texts]


def test_digests_of_a_table(spark):
    rows = corpus()
    out = bpe.round_trip_digests(spark.createDataFrame(rows, DOCS)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((r[0] is None, r[0], len(i := ids_of(r[1])), sha(" ".join(map(str, i))), sha(LIBRARY.decode(i, skip_special_tokens=False))) for r in rows if r[0] is not None)
    assert sorted((False, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out if r["doc_id"] is not None) == want
    assert len(out) == len(rows)


def test_columns_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "Hello, world!", "x"), (2, None, "y")], "doc_id long, text string, ids string")
    out = bpe.decode_column(bpe.encode_column(df)).orderBy("doc_id").collect()
    assert [r["_ids"] for r in out] == [ids_of("Hello, world!"), []]
    assert [r["_decoded"] for r in out] == [LIBRARY.decode(ids_of("Hello, world!"), skip_special_tokens=False), ""]


@pytest.mark.parametrize("n", [0, 1, 70_000, 200_001])
def test_wavelet_lookups(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 49_408, n).astype(np.int32)
    ids[::4] = 5
    m = wavelet.WaveletMatrix(wavelet.pack(ids, [7, None], np.array([n // 2, n])))
    assert np.array_equal(m.all_ids(), ids) and m.doc_ids == [7, None] and m.ends.tolist() == [n // 2, n]
    for i in rng.integers(0, n, 20) if n else []:
        assert m.access(int(i)) == ids[i]
        t = int(ids[i])
        assert m.rank(t, int(i)) == int((ids[:i] == t).sum()) and m.count(t) == int((ids == t).sum())
        assert m.select(t, m.rank(t, int(i))) == i
    assert m.count(49_500) == 0 and m.occurrences(60_000) == []


def test_shards_read_back_in_order(spark):
    rows = corpus()
    out = wavelet.write_and_read(spark.createDataFrame(rows, DOCS), shard_tokens=2000).collect()
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out)
    at, want = 0, {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*ids_of(r[1]), 1], "<u4")
        want.setdefault(r[0], []).append((at, r[0], len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted((x for v in want.values() for x in v), key=lambda x: x[0])
    empty = spark.createDataFrame([], DOCS)
    assert wavelet.write_and_read(empty).count() == 0


def test_shares_and_shortages():
    assert mixing.share_out(100, [1, 1], [30, 200]) == [30, 70]
    assert mixing.share_out(100, [1, 3], [500, 500]) == [25, 75]
    assert mixing.share_out(100, [1, 1], [10, 20]) == [10, 20]
    tokens = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "x", "4"): 1000}
    got = mixing.leaf_budgets(tokens, 400, {}, 1)
    # source 1 gives all it has, its sibling the rest of their language; the domain's own shortage goes to b
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "3"): 100, ("b", "x", "4"): 200}
    got = mixing.leaf_budgets(tokens, 600, {}, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "x", "4"): 390}


def test_mixture_takes_prefixes_of_seeded_epochs(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 30)), "en" if k % 3 else "de", f"src{k % 5}") for k in range(300)]
    rows += [(900, None, "en", "src1"), (901, "", None, None), (902, "a b c", None, "odd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("x"))
    for share, epochs in ((0.4, 1), (1.5, 3)):
        plan = {tuple(r["_leaf"]): r for r in mixing.decisions(df, share, epochs, 7, {}).collect()}
        out = mixing.mix(df, share, epochs, 7, {})
        assert out.columns[: len(df.columns)] == df.columns
        n = {r[0]: len((r[1] or "").split()) for r in rows}
        takes: dict = {}
        for r in out.collect():
            takes.setdefault(tuple(r["_leaf"]), []).append((r["_epoch"], r["doc_id"]))
        for leaf, p in plan.items():
            got = takes.get(leaf, [])
            assert len(set(got)) == len(got)
            whole = [d for e, d in got if e < p["whole"]]
            assert sum(n[d] for d in whole) == p["whole"] * p["tokens"]
            rest = sum(n[d] for e, d in got if e == p["whole"])
            need = p["budget"] - p["whole"] * p["tokens"]
            assert need <= rest < need + 30
        again = mixing.mix(df.repartition(3), share, epochs, 7, {})
        assert sorted((r["doc_id"], r["_epoch"]) for r in again.collect()) == sorted((d, e) for v in takes.values() for e, d in v)
    assert mixing.mix(df.limit(0)).count() == 0
