"""The corpus pipeline, stage by stage, on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm.common import read

DIR = "/root/testdata/sf0.001"


def test_stages_in_order_keep_the_columns(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "bpe"]
    docs = read(spark, DIR, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns, name
        after = docs.count()
        assert 0 < after <= before
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert out.count() == before
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in out.collect())
