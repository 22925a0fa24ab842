"""The last stage decodes what it encoded."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from tests.llm.helpers import DOCS, corpus
from tests.llm.test_tokens import LIBRARY


def test_last_stage_digests_the_decoded_ids(spark):
    out = corpus_pipeline.encode(spark, spark.createDataFrame(corpus(), DOCS), "").collect()
    assert len(out) == len(corpus())
    for r in out:
        text = LIBRARY.decode(r["token_ids"], skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
