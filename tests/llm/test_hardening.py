"""Clashing names, odd rows and exact definitions, operator by operator and stage by stage."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import words
from tidemark.llm import ann, bpe, langid, mixing, pq, queries, sharding, simhash, suffix, toxicity, wavelet
from tidemark.llm.common import columns_of

CLASH = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, Doc_Id string, _ids string, _f0 string, _score string, key string, node string"


def clashing(spark, n=14):
    rng = random.Random(3)
    texts = [words(rng, 60) for _ in range(n)] + [None, "", " \n", words(rng, 60)]
    texts += [texts[0], texts[0]]
    rows = [(k if k % 5 else None, t, "en" if k % 2 else None, f"src{k % 3}", len(t or ""), "x", "y", "z", "0", "1", "k", "n") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[1]], CLASH)


@pytest.mark.parametrize("op", ["op3", "op4", "op5", "op6", "op8", "op9", "op10"])
def test_names_that_differ_in_case_only(spark, op):
    docs = clashing(spark)
    labels = spark.createDataFrame([(1, 0, 1, "a"), (2, 0, 0, "b"), (3, 1, 0, None)], "doc_id long, quality int, toxic int, TOXIC string")
    run = {
        "op3": lambda: langid.predictions(docs), "op4": lambda: bpe.round_trip_digests(docs), "op5": lambda: wavelet.write_and_read(docs),
        "op6": lambda: toxicity.predictions(docs, labels), "op8": lambda: simhash.components_of(docs), "op9": lambda: sharding.shard_by_bytes(docs),
        "op10": lambda: suffix.remove_repeats(docs),
    }[op]
    assert run().count() == docs.count()


def test_columns_that_operators_add_may_be_there(spark):
    docs = clashing(spark)
    out = bpe.encode_column(docs)
    assert out.columns[0] == "_ids_" and out.columns[1:] == docs.columns
    twice = bpe.decode_column(bpe.decode_column(out, ids="_ids_"), ids="_ids_")
    assert twice.columns[:2] == ["_decoded_", "_decoded"]
    prints = simhash.fingerprints(docs)
    assert prints.columns[0] == "_f0_" and prints.count() == docs.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing(spark)
    out = stage(spark, docs, str(tmp_path))
    n = out.count()
    assert 0 < n <= docs.count()
    if name != "bpe":
        assert out.columns == docs.columns
    if name in ("suffix_array_dedup", "bpe", "toxicity"):
        assert n == docs.count()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_two_labels_throw_nothing_away(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs, labels).count() == 8
    assert toxicity.keep_clean(docs, labels, prior=0.9).count() == 8


def test_the_risk_is_the_defined_one_and_its_slope_the_gradient():
    rng = np.random.default_rng(4)
    positive = np.arange(30) < 9
    for shift, prior in ((0.0, 0.3), (2.0, 0.3), (-3.0, 0.8)):
        z = rng.normal(size=30) + shift
        loss = lambda s, x: math.log(1 + math.exp(-s * x))
        plus = prior * sum(loss(1, x) for x in z[:9]) / 9
        minus = sum(loss(-1, x) for x in z[9:]) / 21 - prior * sum(loss(-1, x) for x in z[:9]) / 9
        assert toxicity.risk(z, positive, prior) == (pytest.approx(plus), pytest.approx(minus))
        g, eps = toxicity.slope(z, positive, prior), 1e-6
        for k in range(30):
            up, down = z.copy(), z.copy()
            up[k] += eps
            down[k] -= eps
            (a, b), (c, d) = toxicity.risk(up, positive, prior), toxicity.risk(down, positive, prior)
            want = (a + b - c - d) / (2 * eps) if minus >= 0 else -(b - d) / (2 * eps)
            assert g[k] == pytest.approx(want, abs=1e-6)


def test_long_runs_are_summed_whole():
    known = {"a": 0, "ab": 1, "b": 2, "▁a": 3, "bba": 4}
    table = np.append(np.array([[0.2, 0.1], [0.3, 0.2], [0.1, 0.4], [0.3, 0.1], [0.1, 0.2]]), np.zeros((1, 2)), 0)
    rng = random.Random(2)
    for n in (5, 12):
        word = "▁a" + "".join(rng.choice("ab") for _ in range(n))
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for k, c in enumerate([*cuts, 1]):
                if c:
                    parts.append(word[last : k + 1])
                    last = k + 1
            total += np.prod([table[known[p]] if p in known else np.full(2, langid.UNKNOWN if len(p) == 1 else 0.0) for p in parts], axis=0)
        assert np.allclose(langid.long_likelihood(word, known, table), np.log(total))
    long = "▁" + "ab" * 5000
    got = langid.log_likelihood([long], known, table)[0]
    assert np.isfinite(got).all() and got[0] != got[1]
    half = langid.long_likelihood("▁" + "ab" * 2500, known, table)
    assert np.allclose(got / half, 2, rtol=1e-2)


def test_links_are_at_the_threshold_or_above(spark):
    c = 0.95 - 3e-13
    rows = [(1, [1.0, 0.0]), (2, [c, math.sqrt(1 - c * c)]), (3, [0.0, 1.0]), (4, [0.96, math.sqrt(1 - 0.96**2)])]
    got = {r["vec_id"]: r["n_links"] for r in pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    assert got == {k: sum(float((x[k] * x[j]).sum()) >= 0.95 for j in x if j != k) for k in x}
    assert got[1] == 1


def clustered(n: int = 12_000, dim: int = 32) -> list[dict]:
    """Vectors of many unequal clusters, some of them spread out, and some lengths."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(300, dim))
    x = centres[(300 * rng.random(n) ** 2).astype(int)] + rng.normal(size=(n, dim)) * rng.choice([0.2, 0.6, 1.0], n)[:, None]
    return [{"vec_id": k, "embedding": v} for k, v in enumerate(x.tolist())]


@pytest.mark.parametrize("table", ["sf0.01", "generated"])
def test_recall_of_learned_partitions(spark, table):
    if table == "generated":
        rows = clustered()
        vectors = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in rows], "vec_id long, embedding array<double>")
    else:
        path = f"/root/testdata/{table}/embeddings.parquet"
        vectors, rows = spark.read.parquet(path), pyarrow.parquet.read_table(path).to_pylist()
    got = defaultdict(set)
    for r in ann.search(vectors).collect():
        got[r["query_id"]].add(r["vec_id"])
    rows = [r for r in rows if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hit = total = 0
    for q in np.nonzero(ids % 20 == 0)[0]:
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit, total = hit + len(best & got[int(ids[q])]), total + len(best)
    assert hit / total >= 0.9


def test_few_vectors_come_back_whole(spark):
    for n in (1, 2, 3, 12, 40):
        rows = [(k, np.random.default_rng(k).normal(size=5).tolist()) for k in range(n)]
        out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1).collect()
        assert len(out) == n * min(20, n - 1)


def test_mixture_against_a_recount(spark):
    docs = columns_of(clashing(spark, 60), "doc_id", "text", "lang", "source").dropDuplicates(["doc_id", "text"])
    out = mixing.mix(docs, share=0.7, max_epochs=2, seed=5)
    own = docs.select("doc_id", "text", F.struct(F.coalesce(mixing.domain_of(), F.lit("(none)")).alias("domain"), F.coalesce("lang", F.lit("(none)")).alias("lang"), F.coalesce("source", F.lit("(none)")).alias("source")).alias("leaf"),
                      mixing.word_count().alias("n"), F.xxhash64("text").alias("_h"))
    rows = own.select("*", *(mixing._order(5, F.lit(e).cast("int")).alias(f"o{e}") for e in range(3))).collect()
    tokens = defaultdict(int)
    for r in rows:
        tokens[tuple(r["leaf"])] += r["n"]
    budgets = mixing.leaf_budgets(dict(tokens), 0.7 * sum(tokens.values()), mixing.WEIGHTS, 2)
    want = []
    for leaf, n in tokens.items():
        if not n:
            continue
        whole, part = divmod(budgets[leaf], n)
        here = [r for r in rows if tuple(r["leaf"]) == leaf]
        want += [(r["doc_id"], r["text"], e) for r in here for e in range(whole)]
        start = 0
        for r in sorted(here, key=lambda r: r[f"o{whole}"]):
            if part and start < part:
                want.append((r["doc_id"], r["text"], whole))
            start += r["n"]
    key = lambda t: (t[0] is None, t[0] or 0, t[1] or "", t[2])
    assert sorted(((r["doc_id"], r["text"], r["_epoch"]) for r in out.select("doc_id", "text", "_epoch").collect()), key=key) == sorted(want, key=key)


def test_a_collision_of_one_lane_cuts_nothing(spark):
    rows = [(7, k, 100 + k, 0, 0) for k in range(5)] + [(7, 9, 103, 0, 4), (7, 9, 104, 0, 5)]
    df = spark.createDataFrame(rows, "key0 long, key1 long, doc_id long, _h long, at int")
    found = suffix._neighbours(df, ["key0", "key1"], ["doc_id", "_h", "at"], False, "collision").collect()
    assert [(r["doc_id"], r["at"]) for r in found] == [(104, 5)]
    w = suffix.Words([b"a b c d e f g h i j k l"], suffix.LANES)
    assert (w.window(3, 0) != w.window(3, 1)).all()


def test_registered_queries_are_the_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
