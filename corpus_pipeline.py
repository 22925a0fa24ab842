"""The corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, simhash, suffix, toxicity
from tidemark.llm.common import columns_of, drop_written, first_columns, read, written

#: Part of the words that reach the mixture which it gives to training, and how often it may read a document.
MIX_SHARE, MIX_EPOCHS = 0.9, 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator accepts; it learns from the training labels of this input.

    Null and blank texts stay, equal texts go or stay together, and where no label teaches anything all stay.
    """
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8.

    SimHash fingerprints meet on deletion variants; pairs too far apart for these meet on rare shingles; shingles decide.
    The smallest doc_id stays, null ids last; null and blank texts are one group; of equal rows one stays.
    """
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier place has; every row stays, null and short texts as they are."""
    return first_columns(suffix.remove_repeats(docs), len(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture's leaves take: null languages and sources are leaves too, blank texts come with their place."""
    return first_columns(mixing.mix(docs, share=MIX_SHARE, max_epochs=MIX_EPOCHS), len(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the token ids, and the SHA-256 of the text that these ids decode to.

    Null and blank texts have no ids and the digest of an empty text; every row stays, repeated ones too.
    """
    coded = bpe.coded_column(columns_of(docs, "doc_id", "lang", "source", "text"))
    n, digest = F.size("_ids").cast("long").alias("n_tokens"), F.sha2("_decoded", 256).alias("decoded_sha256")
    return coded.select("doc_id", "lang", "source", n, F.col("_ids").alias("token_ids"), digest)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores, similarity groups and encodings have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
