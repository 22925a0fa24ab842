"""Language identification, toxicity, near vectors and nearest neighbours."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from tests.llm.helpers import components, crc, unit
from tidemark.llm import ann, langid, pq, toxicity

SYLLABLES = {"en": "th er on an re he in ed nd ha at en".split(), "de": "ein ich der sch ung keit zu ge ver ß ü ö".split(), "es": "ción que los as ado ez mi ña ll rr ú í".split()}


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(5, 60))]
        out.append((k, " ".join(words).capitalize() + ".", lang))
    return out


def test_forward_sums_all_segmentations():
    known = {"a": 0, "b": 1, "ab": 2, "▁": 3, "▁a": 4, "ba": 5}
    p = np.array([0.1, 0.2, 0.15, 0.25, 0.2, 0.1])
    table = np.append(p, 0.0)[:, None]
    for word in ("▁ab", "▁aba", "▁bab", "▁aab"):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for k, c in enumerate([*cuts, 1]):
                if c:
                    parts.append(word[last : k + 1])
                    last = k + 1
            total += math.prod(p[known[x]] if x in known else langid.UNKNOWN if len(x) == 1 else 0.0 for x in parts)
        assert langid.log_likelihood([word], known, table)[0, 0] == pytest.approx(math.log(total))


def test_fitting_raises_the_likelihood():
    known = langid.pieces(langid.default_path())
    words = ["▁the", "▁then", "▁these", "▁hen"]
    counts = np.array([5.0, 3, 2, 1])
    score = lambda p: float((langid.log_likelihood(words, known, np.append(p, 0)[:, None])[:, 0] * counts).sum())
    steps = [score(langid.fit_language(words, counts, known, r)) for r in (0, 1, 3, 6)]
    assert steps[1] > steps[0] + 10 and steps[-1] >= steps[1] - 0.01


def test_held_out_languages(spark):
    rows = [(k, t, lang, "x") for k, t, lang in texts(400)] + [(1000, None, "en", None), (1001, " 12 !?", "en", None), (1002, "", None, None), (None, "ción que los", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = {r["doc_id"]: r for r in langid.predictions(df).collect()}
    held = [(k, lang) for k, _, lang in texts(400) if crc(k) % 3 == 1]
    assert all(out[k]["held_out"] for k, _ in held)
    assert sum(out[k]["lang_pred"] == lang for k, lang in held) >= 0.98 * len(held)
    assert [out[k]["lang_pred"] for k in (1000, 1001, 1002, None)] == ["und", "und", "und", "es"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    none = langid.predictions(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert none[0]["lang_pred"] == "und"
    assert langid.predictions(df.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k, t, lang in texts(1500, 4):
        bad = rng.random() < 0.12
        if bad:
            t += " " + " ".join(rng.choice(["zvaku" + s for s in SYLLABLES[lang]] + ["gnarf", "blurgh"]) for _ in range(6))
        rows.append((k, t, lang))
        if rng.random() < 0.5:
            labels.append((k, 1, int(bad)))
    rows += [(5000, None, None), (5001, "", None), (None, "gnarf blurgh gnarf", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _score string")
    l = spark.createDataFrame([*labels, (None, None, 1), (7777, 0, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.predictions(d, l).collect()}
    marks = {k: t for k, _, t in labels if crc(k) % 4 == 2}
    hits = sum(out[k]["predicted"] for k, t in marks.items() if t)
    assert hits >= 0.9 * sum(marks.values())
    assert sum(out[k]["predicted"] for k, t in marks.items() if not t) <= 0.03 * len(marks)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out.values())
    assert out[5000]["predicted"] == out[5001]["predicted"] == 0
    assert toxicity.predictions(d, l.limit(0)).count() == len(rows)
    assert toxicity.predictions(d.limit(0), l).count() == 0
    assert toxicity.keep_clean(d, l).columns == d.columns


def vector_rows(dim=16):
    rng = np.random.default_rng(6)
    base = unit(rng, 300, dim)
    rows = [base[k] * (1 + k % 3) for k in range(300)]
    for k in range(120):  # a tight group, far larger than a block
        rows.append(base[0] + rng.normal(0, 0.03, dim))
    for k in range(60):  # a chain around the threshold
        rows.append(base[1] + rng.normal(0, 0.09, dim))
    rows += [base[2]] * 40
    out = [(k, [float(np.float32(x)) for x in v], k % 4) for k, v in enumerate(rows)]
    n = len(out)
    return [*out, (n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [None] + [1.0] * (dim - 1), 0), (n + 3, [float("nan")] * dim, 0), (n + 4, [float("inf")] + [0.0] * (dim - 1), 0), (n + 5, [1.0, 2.0], 0), (n + 6, [], 0), (None, [1.0] * dim, 0)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def good(rows, dim=16):
    return [(k, np.array(v, float)) for k, v, _ in rows if k is not None and v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)]


@pytest.mark.parametrize("lists", [1, 7, 40])
def test_links_against_brute_force(spark, lists):
    rows = vector_rows()
    use = good(rows)
    u = np.array([v / np.linalg.norm(v) for _, v in use])
    m = u @ u.T >= 0.95
    np.fill_diagonal(m, False)
    comp = components(len(use), zip(*np.nonzero(m), strict=True))
    want = {k: (0, k, True) for k, _, _ in rows if k is not None}
    want |= {use[i][0]: (int(m[i].sum()), use[comp[i]][0], comp[i] == i) for i in range(len(use))}
    out = pq.near_duplicates(spark.createDataFrame(rows, SCHEMA), lists=lists, block=32).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out if r["vec_id"] is not None} == want
    assert len(out) == len(rows)
    assert pq.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest_neighbours_recall_and_ties(spark):
    rows = vector_rows()
    use = good(rows)
    out = ann.search(spark.createDataFrame(rows, SCHEMA), every=10, top=20).collect()
    x, ids = np.array([v for _, v in use]), np.array([k for k, _ in use])
    hit = total = 0
    for i in np.nonzero(ids % 10 == 0)[0]:
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]].tolist()
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == ids[i])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(mine, mine[1:], strict=False))
        hit += len({v for _, v, _ in mine} & set(best))
        total += 20
    assert hit >= 0.9 * total
    few = ann.search(spark.createDataFrame(rows[:3], SCHEMA), every=1).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(q, k) for q in range(3) for k in (1, 2)]
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_partition_is_balanced():
    x = unit(np.random.default_rng(1), 800, 8)
    part = ann.balanced_partition(ann.neighbour_graph(x, 10), 8)
    assert np.bincount(part, minlength=8).max() <= 106 and part.min() >= 0
