"""Toxicity where only toxic rows are labelled."""

from __future__ import annotations

import random

from tests.llm.test_models import SYLLABLES, texts
from tidemark.llm import toxicity


def test_positives_and_unlabelled_text_are_enough(spark):
    rng = random.Random(8)
    rows, bad = [], {}
    for k, t, lang in texts(1500, 4):
        bad[k] = rng.random() < 0.12
        if bad[k]:
            t += " " + " ".join(rng.choice(["zvaku" + s for s in SYLLABLES[lang]] + ["gnarf", "blurgh"]) for _ in range(6))
        rows.append((k, t))
    labels = spark.createDataFrame([(k, 1, 1) for k in bad if bad[k] and rng.random() < 0.5], "doc_id long, quality int, toxic int")
    out = toxicity.predictions(spark.createDataFrame(rows, "doc_id long, text string"), labels).where("held_out").collect()
    told = [(r["predicted"] == 1, bad[r["doc_id"]]) for r in out]
    assert sum(p and b for p, b in told) >= 0.8 * sum(b for _, b in told)
    assert sum(p and b for p, b in told) >= 0.8 * sum(p for p, _ in told)
