"""What the contracts ask of odd tables: every length, every row, runs of any length, no Python behind native operators."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, corpus
from tidemark.llm import ann, langid, mixing, pq, sharding
from tidemark.llm.common import rows_table, scratch

VECTORS = "vec_id long, embedding array<double>"


def test_vectors_of_every_length_are_linked(spark):
    rows = [(k, np.eye(3)[k % 3].tolist()) for k in range(6)] + [(10, [1.0, 1.0]), (11, [1.0, 1.0]), (12, [1.0, -1.0]), (13, [2.0]), (14, [5.0]), (15, [-1.0]), (16, []), (17, [0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False) and got[12] == (0, 12, True)
    assert got[13] == (1, 13, True) and got[14] == (1, 13, False) and got[15] == (0, 15, True)
    assert got[16] == (0, 16, True) and got[17] == (0, 17, True) and got[3] == (1, 0, False)
    assert len(got) == len(rows)


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [0.5, 0.0]), (40, [1.0, 1.0, 1.0]), (41, [1.0, 0.0, 0.0]), (22, None), (60, [3.0])]
    got = sorted(map(tuple, ann.search(spark.createDataFrame(rows, VECTORS), every=20).collect()))
    assert got == sorted([(20, 1, 20, 1.0), (20, 2, 21, 0.5), (20, 1, 20, 1.0), (20, 2, 21, 0.5), (40, 1, 41, 1.0)])
    assert ann.search(spark.createDataFrame([], VECTORS)).collect() == []


def test_long_runs_teach_as_short_ones_do(monkeypatch):
    known = {"a": 0, "ab": 1, "b": 2, "▁a": 3, "bba": 4}
    p = np.array([0.2, 0.3, 0.1, 0.3, 0.1])
    rng = random.Random(3)
    words = ["▁a" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    counts = np.array([rng.randrange(1, 5) for _ in words])
    want = langid.expected_counts(words, counts, known, p)
    assert np.allclose(langid.long_counts(words, counts, known, np.append(p, 0.0))[:-1], want)
    monkeypatch.setattr(langid, "LONG", 20)
    monkeypatch.setattr(langid, "CELLS", 900)
    assert np.allclose(langid.expected_counts(words, counts, known, p), want)
    long = "▁" + "ab" * 4000  # pieces cover it whole, so their expected letters are all but the first
    got = langid.expected_counts([long], np.array([1]), known, p)
    assert np.isfinite(got).all() and np.isclose(sum(got[k] * len(n.removeprefix("▁")) for n, k in known.items()), 8000, rtol=1e-3)


def test_a_language_without_blanks_is_learned(spark):
    rng = random.Random(7)
    rows = []
    for k in range(80):
        lang, letters = (("xx", "ato"), ("yy", "eiu"))[k % 2]
        rows.append((k, "".join(rng.choice(letters) for _ in range(300)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predictions(docs).collect()}
    assert all(got[k] == lang for k, _, lang in rows)


def python_behind(df) -> list[str]:
    plan = df._jdf.queryExecution().toString() + df._jdf.queryExecution().toRdd().toDebugString()
    return [w for w in ("PythonRDD", "PythonUDF", "MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython") if w in plan]


def test_native_operators_run_no_python(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(6, 200), DOCS)
    path_of = docs.write.mode("overwrite")
    import tempfile

    where = tempfile.mkdtemp()
    path_of.parquet(where)
    docs = spark.read.parquet(where)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(AssertionError("rows of Python")))
    monkeypatch.setattr(sharding, "RANGES", 8)
    assert not python_behind(mixing.mix(docs, share=0.6)) and not python_behind(mixing.decisions(docs, 0.6, 2, 7))
    assert not python_behind(sharding.shard_by_bytes(docs, shards=5))
    assert sharding.cuts_of(docs.groupBy(F.shiftrightunsigned(F.xxhash64("text"), 1).alias("key")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("bytes")), 5, 2)


def test_more_leaves_than_are_sent_to_tasks(spark, monkeypatch):
    rows = [(k, f"a b c {k}", "en", f"site{k % 50}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    few = sorted(r["doc_id"] for r in mixing.mix(docs, share=0.5).collect())
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 3)
    assert sorted(r["doc_id"] for r in mixing.mix(docs, share=0.5).collect()) == few


def test_rows_of_the_driver_as_a_table(spark):
    with scratch():
        rows = [{"a": k, "s": {"x": None if k % 3 else f"é\n\"{k}"}} for k in range(9000)]
        got = rows_table(spark, rows, "a long, s struct<x:string>", "rows").orderBy("a").collect()
        assert [(r["a"], r["s"]["x"]) for r in got] == [(r["a"], r["s"]["x"]) for r in rows]
        assert rows_table(spark, [], "a long", "none").count() == 0
