"""Target-distribution importance resampling.

Texts are bags of hashed runs of one and two words. A bucket's gain is the log-ratio of its smoothed
share in the target to that in the corpus; a document's weight is the mean gain of its features,
scored as arrays in Arrow batches. A seeded Gumbel term turns the greatest scores into a draw without
replacement by weight. Scores are integers from a bounded range, so their exact histogram is small:
its suffix sums say how many documents lie above each score, where the cutoff is, and at which rank
each surviving score begins. Only documents at or above the cutoff are numbered, inside their score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, columns_of, drop_written, text_slices, written
from tidemark.llm.words import Runs, letters

#: Buckets of features: what the driver holds of either side is this many counts.
BUCKETS = 10_000
#: Words below which a document is not drawn, and the share of the others that is, in hundredths.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
BATCH_BYTES = 4 << 20
#: ASCII bytes that no word has; A-Z are lowered before.
GAPS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_KIND = letters(GAPS)
_BITS = np.arange(32, dtype=np.uint32)


def _applied(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map on 32 bits, given by its columns, of each number."""
    on = (x[:, None] >> _BITS & np.uint32(1)).astype(bool)
    return np.bitwise_xor.reduce(np.where(on, columns, np.uint32(0)), axis=1)


@lru_cache(64)
def _doubled(k: int) -> np.ndarray:
    """Columns of what 2**k zero bytes do to a CRC-32 that they follow."""
    if k:
        half = _doubled(k - 1)
        return _applied(half, half)
    # a byte more: crc(m + 0) = step(crc(m)), where the check of a lone byte holds the inner table
    table = np.array([zlib.crc32(bytes([v])) for v in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
    one = np.uint32(1) << _BITS
    return (one >> np.uint32(8)) ^ table[one & np.uint32(255)]


@lru_cache(2048)
def _passed(n: int) -> np.ndarray:
    """4 x 256: what ``n`` bytes that follow make of each byte of a CRC-32; the four are combined by exclusive or."""
    columns = np.uint32(1) << _BITS
    for k in range(n.bit_length()):
        if n >> k & 1:
            columns = _applied(_doubled(k), columns)
    return np.stack([_applied(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)])


def joined_crc(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together, from those of both parts and the right one's size in bytes."""
    if not len(left):
        return np.zeros(0, np.uint32)
    kinds, which = np.unique(size, return_inverse=True)
    tables = np.stack([_passed(int(n)) for n in kinds])
    out = right.copy()
    for j in range(4):
        out ^= tables[which, j, left >> np.uint32(8 * j) & np.uint32(255)]
    return out


def _features(texts: pa.Array, buckets: int) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """The words, the bucket of each, the places of those that another follows in the same text, and the pairs' buckets."""
    runs = Runs(texts, _KIND)
    coded = runs.words.dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    at = np.asarray(coded.indices)
    own = np.array([zlib.crc32(w) for w in names], np.uint32)[at]
    led = np.array([zlib.crc32(w + b" ") for w in names], np.uint32)[at]
    text = runs.text_of()
    pair = np.nonzero(text[1:] == text[:-1])[0]
    both = joined_crc(led[pair], own[pair + 1], runs.size[pair + 1])
    return runs, own % np.uint32(buckets), pair, both % np.uint32(buckets)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features of all ``text`` fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_slices(batches, "text", BATCH_BYTES):
            _, one, _, two = _features(batch["text"], buckets)
            total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        on = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on])], names=["bucket", "n"])

    out = [0] * buckets
    # a row per bucket
    for r in arrow_map(columns_of(texts, "text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log-ratio of smoothed shares, rounded down, for each bucket."""
    s_all, t_all, n = sum(corpus), sum(target), len(corpus)
    return [
        math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n))))
        for s, t in zip(corpus, target, strict=True)
    ]


def _noise(seed: int) -> Column:
    """Thousandths of a Gumbel number that the id and the seed decide, rounded down."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scores(docs: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document; the gains are one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.array(gain, np.int64)
        for batch in text_slices(batches, "text", BATCH_BYTES):
            runs, one, pair, two = _features(batch["text"], len(value))
            each = value[one]
            each[pair] += value[two]
            upto = np.append(0, np.cumsum(each))
            words = runs.last - runs.first
            n = words + np.maximum(words - 1, 0)
            weight = (upto[runs.last] - upto[runs.first]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = columns_of(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = arrow_map(rows, run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return scored.withColumn("score", F.col("weight") + _noise(seed))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... by score, ties to the smaller doc_id, null where a document is not drawn.

    Gains lie within 1000 ln(2**63) of zero and the noise between -3,132 and 22,875, so there are at
    most 113,400 different scores whatever the table: that bounds the histogram and what is broadcast.
    """
    scored = written(scored, "scored")
    able = F.col("n_words") >= least_words
    histogram = written(scored.where(able).groupBy("score").agg(F.count("*").alias("n")), "scores")
    wanted = percent * (histogram.agg(F.sum("n")).first()[0] or 0) // 100
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    surviving = written(histogram.select("score", above.alias("above")).where(F.col("above") < wanted), "surviving")
    cutoff = surviving.agg(F.min("score")).first()[0]
    drop_written(histogram)
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    names = scored.columns
    # equal rows come together before they meet in their score, and part again with ranks of their own
    few = scored.where(able & (F.col("score") >= cutoff)).groupBy(*names).agg(F.count("*").alias("_times"))
    few = few.join(F.broadcast(surviving), "score")
    inside = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("_start", F.col("above") + F.coalesce(F.sum("_times").over(inside), F.lit(0)))
    few = few.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    place = F.col("_start") + F.col("_k")
    drawn = few.select(*names, F.when(place <= wanted, place).alias("rank"))
    rest = scored.where(~able | (F.col("score") < cutoff)).select(*names, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document, drawn to be like the texts of ``target``.

    Defined cases: null and blank texts have no features and weight 0, and are never drawn where
    ``least_words`` is above 0; a null id is hashed as an empty one and comes last among ties; equal rows take
    ranks one after the other; an empty target gives every feature a gain that only the corpus decides; an
    empty table gives no rows; other columns are ignored, also where a name differs in case only.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return draw(scores(docs, gain, seed), percent, least_words)
