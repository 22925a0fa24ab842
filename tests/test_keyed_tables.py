"""Keyed tables: a batch writes what it brings, merging is seldom, and a crash at any step loses and repeats nothing."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.tables import KeyedTable

SCHEMA = "k long, at long, v string, gone boolean, until timestamp"


def table(spark, path, **more):
    return KeyedTable(spark, f"file://{path}", ["k"], "at", 4, gone="gone", **more)


def frame(spark, rows):
    return spark.createDataFrame([(k, at, v, gone, None) for k, at, v, gone in rows], SCHEMA).withColumn("until", F.col("until"))


def state(t):
    return {r["k"]: r["v"] for r in t.current().collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def batches(n):
    rng = random.Random(2)
    return [[(rng.randrange(12), b * 10 + j % 7, f"{b}-{j}", rng.random() < 0.2) for j in range(8)] for b in range(n)]


def expected(all_, upto):
    """The greatest by order; of equals in one batch the greatest row, of several batches the last."""
    best = {}
    for b, rows in enumerate(all_[:upto]):
        for k, at, v, gone in rows:
            best[k] = max(best.get(k, (-1, -1, "", False)), (at, b, v, gone))
    return {k: x[2] for k, x in best.items() if not x[3]}


def test_newest_rows_survive_merging(spark, tmp_path):
    t, all_ = table(spark, tmp_path / "t"), batches(7)
    for b, rows in enumerate(all_):
        t.put(frame(spark, rows), b, "s")
        t.compact(3)
        t.clean()
        assert state(t) == expected(all_, b + 1)
    t.put(frame(spark, all_[0]), 6, "s")  # a batch that is in already
    assert state(t) == expected(all_, 7)
    runs = t.manifest()["runs"]
    assert [r[1] for r in runs] == sorted((r[1] for r in runs), reverse=True) and len(runs) <= 4
    for k in range(12):
        assert {r["k"]: r["v"] for r in t.lookup(k=k).collect()} == {key: v for key, v in expected(all_, 7).items() if key == k}


def test_bytes_written_follow_the_batch(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.put(spark.range(200_000).selectExpr("id AS k", "0L AS at", "uuid() AS v", "false AS gone", "CAST(NULL AS TIMESTAMP) AS until"), 0)
    before = size(tmp_path)
    for b in range(1, 4):
        t.put(frame(spark, [(b, b, "new", False)]), b)
        t.compact()
    assert size(tmp_path) - before < before / 50
    assert t.current().count() == 200_000 and t.lookup(k=2).first()["v"] == "new"
    files = t.lookup(k=2).inputFiles()
    assert files


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["before run", "after run", "before commit", "torn commit", "after commit"])
@pytest.mark.parametrize("where", ["put", "compact"])
def test_a_crash_between_any_two_steps(spark, tmp_path, monkeypatch, step, where):
    all_ = batches(4)
    t = table(spark, tmp_path / "t")
    for b in range(3):
        t.put(frame(spark, all_[b]), b, "s")
    run, commit = KeyedTable._write_run, KeyedTable._commit

    def bad_run(self, rows):
        if step == "before run":
            raise Crash
        out = run(self, rows)
        if step == "after run":
            raise Crash
        return out

    def bad_commit(self, said):
        if step == "before commit":
            raise Crash
        if step == "torn commit":
            (tmp_path / "t/log/_half").write_text("{")
            raise Crash
        commit(self, said)
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_write_run", bad_run)
        m.setattr(KeyedTable, "_commit", bad_commit)
        with pytest.raises(Crash):
            t.put(frame(spark, all_[3]), 3, "s") if where == "put" else t.compact(3)
    assert state(t) == expected(all_, 4 if (where, step) == ("put", "after commit") else 3)
    t.put(frame(spark, all_[3]), 3, "s")  # the stream runs the batch again
    t.compact(3)
    t.clean(1)
    assert state(t) == expected(all_, 4)
    named = {r[0] for r in t.manifest()["runs"]}
    assert set(os.listdir(tmp_path / "t/data")) == named and len(os.listdir(tmp_path / "t/log")) <= 2


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    a, b = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    a.put(frame(spark, [(1, 1, "x", False)]), 0, "a")
    said = b.manifest()
    a.put(frame(spark, [(1, 2, "y", False)]), 1, "a")
    with pytest.raises(RuntimeError, match="another writer"):
        b._commit(said | {"version": said["version"] + 1, "runs": []})
    assert state(a) == {1: "y"}


def test_expired_rows_go_when_nothing_older_is_left_to_hide(spark, tmp_path):
    t = table(spark, tmp_path / "t", expires="until")
    at = lambda s: F.lit(s).cast("timestamp")
    for b in range(3):
        t.put(frame(spark, [(b, b, f"v{b}", False)]).withColumn("until", at(f"2024-01-0{b + 1} 00:00:00")), b)
    assert sorted(r["k"] for r in t.current(at("2024-01-02 12:00:00")).collect()) == [2]
    t.compact(3, at("2024-01-02 12:00:00"))
    assert [r["k"] for r in t.current().collect()] == [2]
