"""The whole pipeline against a plain version of each of its stages."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import components, words
from tests.llm.test_copies import brute_spans
from tests.llm.test_tokens import LIBRARY
from tidemark.llm import mixing, toxicity

BAD = ["gnarf", "zvakuth", "blurghed", "skrwumpf"]


def fixture(seed=12):
    rng = random.Random(seed)
    texts: list[str | None] = [words(rng, rng.randrange(60, 140), 4000) for _ in range(160)]
    for k in range(0, 150, 8):
        texts[k] += " " + " ".join(rng.choices(BAD, k=14))
    passage = words(rng, 64, 10**6)
    texts += [f"{words(rng, 9)} {passage} {words(rng, 11)}", f"{passage} {words(rng, 30)}", texts[1], None, "", texts[2]]
    near = texts[3].split()
    near[40] = "changed"
    texts += [" ".join(near), texts[4].upper(), passage]
    rows = [(k, t, ("en", "de", None)[k % 3], f"src{k % 4}" if k % 9 else None, len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, 1, int(k < 150 and k % 8 == 0)) for k in range(160)]
    return rows, labels


def score(text, model):
    held = {w.lower().strip(toxicity.MARKS) for w in (text or "").split()}
    n = defaultdict(int)
    for w in held:
        for f in set(toxicity.features_of(w)):
            n[f] += 1
    z = model.bias
    for k, name in enumerate(model.words):
        z += sum(model.weights[k * len(toxicity.LEVELS) + j] for j, least in enumerate(toxicity.LEVELS) if n[name] >= least)
    return 1 / (1 + math.exp(-z))


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_run_equals_the_plain_stages(spark, tmp_path):
    rows, labels = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))

    model = toxicity.fit(docs.select("doc_id", "text"), marks.select("doc_id", "toxic"))
    bare = 1 / (1 + math.exp(-model.bias))
    left = [r for r in rows if not ((s := score(r[1], model)) >= toxicity.THRESHOLD and s > bare)]
    assert 0 < len(left) < len(rows)

    sets = [shingles(r[1]) for r in left]
    alike = lambda a, b: a == b or (a | b) and 5 * len(a & b) >= 4 * len(a | b)
    root = components(len(left), [(i, j) for i in range(len(left)) for j in range(i) if alike(sets[i], sets[j])])
    left = [r for k, r in enumerate(left) if root[k] == k]

    spans = brute_spans([(r[0], r[1]) for r in left])
    cut = []
    for r in left:
        gone = spans[r[0], r[1]]
        kept = [w for w, g in zip((r[1] or "").split(), gone, strict=True) if not g]
        cut.append((r[0], r[1] if not any(gone) else None, kept, r[2], r[3]))
    assert any(c[1] is None and c[2] for c in cut)

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the places of the mixture depend on the very texts, so they are taken from the stages before it
    before = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, before, str(tmp_path)).write.parquet(path := str(tmp_path / f"s{random.random()}"))
        before = spark.read.parquet(path)
    have = {r["doc_id"]: r for r in before.collect()}
    assert {c[0]: c[2] for c in cut} == {k: (r["text"] or "").split() for k, r in have.items()}

    leaf = F.struct(F.coalesce(mixing.domain_of(), F.lit("(none)")), F.coalesce("lang", F.lit("(none)")), F.coalesce("source", F.lit("(none)")))
    placed = before.withColumn("_h", F.xxhash64("text")).select("doc_id", "text", leaf.alias("leaf"), mixing.word_count().alias("n"), *(mixing._order(7, F.lit(e).cast("int")).alias(f"o{e}") for e in range(2))).collect()
    tokens = defaultdict(int)
    for r in placed:
        tokens[tuple(r["leaf"])] += r["n"]
    budgets = mixing.leaf_budgets(dict(tokens), corpus_pipeline.MIX_SHARE * sum(tokens.values()), mixing.WEIGHTS, corpus_pipeline.MIX_EPOCHS)
    want = {}
    for name, n in tokens.items():
        if not n:
            continue
        whole, part = divmod(budgets[name], n)
        start = 0
        for r in sorted((r for r in placed if tuple(r["leaf"]) == name), key=lambda r: r[f"o{whole}"]):
            if whole or start < part:
                want[r["doc_id"]] = r["text"]
            start += r["n"]

    assert {r["doc_id"] for r in out} == set(want) and len(out) == len(want)
    for r in out:
        ids = LIBRARY.encode(want[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
