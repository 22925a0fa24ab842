"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, collocations, importance, langid, mixing, packing, pq, sharding, simhash, suffix, toxicity, wavelet
from tidemark.llm.common import read


def op1_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"))


def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.write_and_read(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "_leaf.domain", F.col("_leaf.lang").alias("lang"), F.col("_leaf.source").alias("source"), F.col("_budget").alias("leaf_budget"), F.col("_epoch").alias("epoch"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("_spans", F.lit(0), lambda s, x: s + x["to"] - x["from"])
    return cut.select("doc_id", F.col("_words").alias("n_words"), gone.cast("long").alias("removed_words"), F.col("_spans").alias("spans"), "text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best_phrases(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pq_near_dedup, op2_learned_partitions, op3_language_id, op4_bpe, op5_wavelet_shards,
        op6_toxicity, op7_mixing, op8_simhash, op9_minimax_sharding, op10_suffix_dedup,
        op11_importance_resampling, op12_best_fit_packing, op13_collocations,
    )
}

#: All pairs and a closure: fit for the small tables on which results are compared.
ORACLE_SQL: dict[str, str] = {
    "op1_pq_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
      c AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT c.vec_id, l.b FROM c JOIN l ON l.a = c.other),
      k AS (SELECT vec_id, min(other) AS component_id FROM c GROUP BY 1)
      SELECT k.vec_id, coalesce(n.n, 0) AS n_links, component_id, k.vec_id = component_id AS kept FROM k LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = k.vec_id""",
    "op11_importance_resampling": """WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
      e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
      f AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d) GROUP BY 1, 2),
      g AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM e UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM e) GROUP BY 1),
      x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM f UNION SELECT f FROM g)),
      y AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM x),
      b AS (SELECT f, xor(list_reduce(bytes, lambda c, v: list_reduce(range(8), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)), xor(c, v)), 4294967295), 4294967295) % 10000 AS bucket FROM y),
      s AS (SELECT bucket, sum(n)::BIGINT AS s FROM f JOIN b USING (f) GROUP BY 1),
      t AS (SELECT bucket, sum(n)::BIGINT AS t FROM g JOIN b USING (f) GROUP BY 1),
      o AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::BIGINT AS S_ALL, (SELECT coalesce(sum(t), 0) FROM t)::BIGINT AS T_ALL),
      v AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (S_ALL + 10000)::DOUBLE / ((s + 1)::DOUBLE * (T_ALL + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), o),
      m AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS gain FROM f JOIN b USING (f) JOIN v USING (bucket) GROUP BY 1),
      w AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (gain - ((gain % n) + n) % n) // n END AS weight,
          ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
      p AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
      r AS (SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able_all FROM p)
      SELECT doc_id, n_words, n_features, weight, score, CASE WHEN able AND place <= 25 * able_all // 100 THEN place END AS rank FROM r""",
    "op13_collocations": """WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
      w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
      t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
      g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g FROM w, (SELECT unnest(range(1, 5)) AS k)),
      f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
      o AS (SELECT lang, x, max(a) AS a FROM (SELECT lang, g[:k - 1] AS x, a FROM f WHERE k > 2 UNION ALL SELECT lang, g[2:] AS x, a FROM f WHERE k > 2) GROUP BY 1, 2),
      s AS (SELECT lang, k, g, a FROM f LEFT JOIN (SELECT lang, x AS g, a AS over FROM o) USING (lang, g) WHERE k > 1 AND (over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * a)),
      c AS (SELECT lang, s.g, s.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * s.a // (x.a::HUGEINT + y.a))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM s) s JOIN f x USING (lang) JOIN f y USING (lang) WHERE x.g = s.g[:j] AND y.g = s.g[j + 1:]),
      b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS best FROM c),
      z AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b JOIN t USING (lang) WHERE best = 1),
      q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z)
      SELECT * FROM q WHERE rank <= 2000""",
}
