"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled sample is drawn from all texts, toxic ones
included. The risk is that of Kiryo et al. (2017): prior * E_P[loss(+)] + max(0, E_U[loss(-)]
- prior * E_P[loss(-)]), with the logistic loss, so the logit estimates the true odds. The model is
linear, with an L1 penalty, over words and word beginnings, which also meet inflected forms, and over
whether one, two or four different words of a text have them. It is fitted with numpy on a sample bounded by ``MAX_POSITIVE``
and ``MAX_UNLABELLED`` rows, the first by a hash of their ids; every row is scored over its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, columns_of, crc_of_id, drop_written, restored, shielded, text_slices, written

MAX_POSITIVE, MAX_UNLABELLED = 1500, 6000
#: Sampled positives that must hold a feature, how many times likelier it must be in them, and by how many standard
#: deviations: what is no likelier in confirmed texts has no weight of its own.
LEAST_POSITIVE, LIFT, DEVIATIONS = 4, 2.0, 5.0
#: Lengths of word beginnings, and how many different words of a text must have a feature.
BEGINNINGS, LEVELS = (4, 5, 6, 7), (1, 2, 4)
THRESHOLD = 0.3
#: Class prior where labels name toxic rows only and none is given: the score of the model that knows nothing, logit -2.
PRIOR = 0.12
BATCH_BYTES = 4 << 20
MARKS = ".,;:!?\"'()[]{}<>|*_-–—«»“”‘’¿¡…#@/\\"


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    weights: np.ndarray
    bias: float


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Folded words of all texts, end to end, and the row of each."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = pc.utf8_trim(pc.utf8_lower(lists.flatten()), characters=MARKS)
    return words, np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))


def features_of(word: str) -> list[str]:
    """The word itself, with a mark in front, and its beginnings."""
    return [" " + word, *(word[:k] for k in BEGINNINGS if k < len(word))] if word else []


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk at logits z: prior * E_P[loss(+)], and E_U[loss(-)] - prior * E_P[loss(-)], which counts as zero below."""
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)
    return float(prior * plus[positive].sum() / n_p), float(minus[~positive].sum() / n_u - prior * minus[positive].sum() / n_p)


def slope(z: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """The step's direction at each logit: the risk's gradient, or, where its second part is negative, back from that part."""
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    back = np.where(positive, -prior * p / n_p, p / n_u)
    return np.where(positive, -prior * (1 - p) / n_p, 0.0) + back if risk(z, positive, prior)[1] >= 0 else -back


def nnpu(
    rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float, steps: int = 400, rate: float = 0.03, sparse: float = 1e-3
) -> tuple[np.ndarray, float]:
    """Weights and bias. ``rows``: features each text has; ``positive``: whether it is a confirmed one."""
    flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = slope(np.bincount(row, w[flat], len(rows)) + b, positive, prior)
        grad = np.append(np.bincount(flat, g[row], size), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        pace = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        step = pace * m / (1 - 0.9**t)
        w, b = w - step[:-1], b - float(step[-1])
        w = np.sign(w) * np.maximum(np.abs(w) - sparse * pace[:-1], 0)
    return w, b + _shift(np.bincount(row, w[flat], len(rows))[~positive] + b, prior)


def _shift(z: np.ndarray, prior: float) -> float:
    """What logits have to move for the mean score of the unlabelled to be the class prior."""
    lo, hi = -30.0, 30.0
    for _ in range(60 if len(z) else 0):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (1 / (1 + np.exp(-np.clip(z + mid, -40, 40)))).mean() > prior else (mid, hi)
    return (lo + hi) / 2


def _sampled(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[DataFrame, float] | None:
    """Bounded training rows (text, positive), and the class prior: the given one, else the share of toxic among labelled ones."""
    train = F.pmod(crc_of_id(), F.lit(4)) != 2
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    marks = marks.where(train)
    told = marks.agg(F.count("*").alias("n"), F.sum((F.col("_toxic") == 1).cast("int")).alias("k")).first()
    if not told["k"]:
        return None
    if prior is None:
        prior = told["k"] / told["n"] if told["k"] < told["n"] else PRIOR
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    places = marks.select("doc_id", (F.col("_toxic") == 1).alias("_positive"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & train).distinct().join(places, "doc_id", "left")
    first = lambda rows, k: rows.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(k)
    # the unlabelled sample is drawn from all rows, confirmed ones included, as the prior is theirs
    chosen = first(ids.where("_positive"), MAX_POSITIVE).unionByName(first(ids, MAX_UNLABELLED).withColumn("_positive", F.lit(False)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # MAX_POSITIVE + MAX_UNLABELLED rows
    return written(rows.select("text", "_positive"), "sample"), prior


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2. Without a toxic label the model knows nothing; with toxic ones
    only, ``prior`` or PRIOR is the share of toxic texts."""
    got = _sampled(docs, labels, prior)
    if got is None:
        return Model((), np.zeros(0), -2.0)
    sample, prior = got

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            flat, row = word_lists(batch["text"])
            coded = flat.dictionary_encode()
            names = np.asarray(coded.dictionary.to_pylist(), object)
            pairs = np.unique(row * max(1, len(names)) + np.asarray(coded.indices))
            lists = [set() for _ in range(batch.num_rows)]
            for p in pairs.tolist():
                lists[p // len(names)].update(features_of(names[p % len(names)]))
            lists = [sorted(x) for x in lists]
            yield pa.RecordBatch.from_arrays([batch["_positive"], pa.array(lists, pa.list_(pa.string()))], names=["positive", "words"])

    each = arrow_map(sample, words, "positive boolean, words array<string>")
    # only what enough positives hold can count for anything
    often = each.where("positive").select(F.explode("words").alias("word")).groupBy("word").count()
    often = often.where(F.col("count") >= LEAST_POSITIVE)  # of MAX_POSITIVE texts
    vocabulary = tuple(sorted(r["word"] for r in often.collect()))
    place = {w: k for k, w in enumerate(vocabulary)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["_positive"], pa.array(_present(batch["text"], place), pa.list_(pa.int32()))], names=["positive", "at"])

    table = arrow_map(sample, numbers, "positive boolean, at array<int>").toArrow()
    rows = [np.asarray(a.values) for a in table["at"].combine_chunks()]
    positive = np.asarray(table["positive"].to_pylist(), bool)
    held = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, p in zip(rows, positive, strict=True) if p == side)]), minlength=len(place) * len(LEVELS)) for side in (True, False)]
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    pooled = (held[0] + held[1] + 1) / (n_p + n_u + 2)
    apart = (held[0] / n_p - held[1] / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    keep = (held[0] * n_u > LIFT * (held[1] + 1) * n_p) & (apart > DEVIATIONS)
    names = np.cumsum(keep) - 1
    drop_written(sample)
    weights, bias = nnpu([names[r[keep[r]]] for r in rows], positive, int(keep.sum()), prior)
    used = np.nonzero(weights)[0]
    own = np.nonzero(keep)[0][used]  # feature numbers, a level each
    words = sorted({int(k) // len(LEVELS) for k in own})
    table = np.zeros(len(words) * len(LEVELS))
    for k, w in zip(own.tolist(), weights[used].tolist(), strict=True):
        table[words.index(k // len(LEVELS)) * len(LEVELS) + k % len(LEVELS)] = w
    return Model(tuple(vocabulary[k] for k in words), table, bias)


def _present(texts: pa.Array, place: dict[str, int]) -> list[np.ndarray]:
    """Numbers of the known features, a number for each level, that each text has; every distinct word is looked up once."""
    words, row = word_lists(texts)
    coded = words.dictionary_encode()
    flat: list[int] = []
    counts: list[int] = []
    get = place.get
    for w in coded.dictionary.to_pylist():
        at = [k for f in features_of(w) if (k := get(f)) is not None]
        flat += at
        counts.append(len(at))
    size, which = np.asarray(counts, np.int64), np.asarray(coded.indices)
    some = np.nonzero(size[which] > 0)[0]
    pair = np.unique(row[some].astype(np.int64) * max(1, len(size)) + which[some])  # different words of a text
    row, which = pair // max(1, len(size)), pair % max(1, len(size))
    n = size[which]
    firsts = (np.cumsum(size) - size)[which]
    at = np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    width = max(1, len(place) * len(LEVELS))
    base, times = np.unique(np.repeat(row, n) * width + np.asarray(flat, np.int64)[at] * len(LEVELS), return_counts=True)
    key = np.sort(np.concatenate([base[times >= least] + k for k, least in enumerate(LEVELS)]))
    return np.split((key % width).astype(np.int32), np.searchsorted(key, np.arange(1, len(texts)) * width))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_score`` (0 to 1) added in front; every column stays. Null and empty texts get the bare bias."""
    weights, bias, names = model.weights, model.bias, model.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(names)}
        for batch in text_slices(batches, "text", BATCH_BYTES):
            z = np.array([weights[at].sum() for at in _present(batch["text"], place)]) + bias
            out = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([out, *batch.columns], names=["_score", *batch.schema.names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"_score double, {kept}")


def predictions(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Defined cases: null and empty texts score the bias; very long texts are scored whole; null ids are
    not held out and train nothing; of several labels of an id the toxic one counts; texts of equal
    words score alike; repeated rows give a row each; other columns are ignored, also where a name
    differs in case only; an empty table gives no rows.
    """
    docs, labels = columns_of(docs, "doc_id", "text"), columns_of(labels, "doc_id", "toxic")
    out = score(docs, fit(docs, labels, prior))
    held = F.coalesce(F.pmod(crc_of_id(), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, prior: float | None = None) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, and more than a text of which nothing is known; every column stays.

    Defined cases: null, blank and empty texts stay, and so does everything where nothing is learned,
    whatever the class prior; repeated rows go or stay together; null ids are scored like others;
    columns may have any names; an empty table gives none.
    """
    rows, inner = shielded(docs)
    model = fit(columns_of(docs, "doc_id", "text"), columns_of(labels, "doc_id", "toxic"), prior)
    bare = 1 / (1 + float(np.exp(-np.clip(model.bias, -40, 40))))
    toxic = (F.col("_score") >= threshold) & (F.col("_score") > bare)
    return restored(score(rows, model).where(~toxic), docs, inner)
