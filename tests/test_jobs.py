"""Jobs, counters, providers and summaries."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import jobs


def test_jobs_take_batches_configs_and_report_counts(spark):
    def factory():
        class Sum:
            def __init__(self):
                self.factor, self.counts = 1.0, jobs.Counters()

            def configure(self, config):
                self.factor = float(config)

            def process(self, batch):
                self.counts.add("rows", len(batch))
                if (batch["v"] < 0).any():
                    raise ValueError("negative")
                return pd.DataFrame({"total": [float(batch["v"].sum()) * self.factor]})

            def drain(self):
                return self.counts.drain()

        return Sum()

    rows = [(1, 0, 0, 1.0, None), (1, 1, 0, 2.0, None), (1, 2, 1, None, "10"), (1, 3, 1, 3.0, None), (2, 0, 0, 1.0, None), (2, 1, 1, -1.0, None), (2, 2, 2, 5.0, None)]
    df = spark.createDataFrame(rows, "s int, k int, batch int, v double, config string")
    out = jobs.ran(df, ["s"], "k", factory, "total double").collect()
    one = [r for r in out if r["s"] == 1]
    assert [r["total"] for r in one if r["total"] is not None] == [3.0, 30.0]
    assert [r["delta"] for r in one if r["counter"] == "rows"] == [2.0, 1.0]
    two = [r for r in out if r["s"] == 2]
    assert [r["total"] for r in two if r["total"] is not None] == [1.0]
    assert [r["delta"] for r in two if r["counter"]] == [1.0, 1.0] and two[-1]["error"] == "ValueError: negative"


def test_counts_are_observed_in_passing(spark):
    df, seen = jobs.observed(spark.range(10), "odd", odd=F.count_if(F.col("id") % 2 == 1))
    assert df.count() == 10 and seen.get == {"odd": 5}


def test_providers_by_key(spark):
    p = jobs.Providers()
    p.register("up", lambda df: df.withColumn("t", F.upper("t")))
    p.register("twice", lambda df: df.withColumn("t", F.concat("t", "t")))
    with pytest.raises(ValueError):
        p.register("up", lambda df: df)
    df = spark.createDataFrame([("up", "a"), ("twice", "b"), ("none", "c"), (None, "d")], "p string, t string")
    assert sorted(r["t"] for r in p.applied(df, "p").collect()) == ["A", "bb"]
    assert sorted(r["t"] for r in p.refused(df, "p").collect()) == ["c", "d"]


def test_summaries_recurse_until_one_section(spark):
    text = " ".join(f"word{k}." for k in range(200))
    short = lambda t: " ".join(t.split()[:3])
    summary, sections, passes, done = jobs.summarised(text, short, 100)
    assert done and summary == "word0. word1. word2." and sections > 10 and passes == 4
    assert jobs.summarised(text, lambda t: t, 100)[3] is False
    assert jobs.summarised("", short, 100) == (None, 0, 1, False)
    out = jobs.summaries(spark.createDataFrame([(1, "a b c d")], "k int, t string"), "k", "t", short).first()
    assert out["summary"] == "a b c" and out["converged"]
