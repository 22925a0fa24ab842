"""Report queries: a customer's orders are turns of a file, shipments words, suppliers machines, parts targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reports
from tidemark.plans.register import Registry, table

registry = Registry()

#: Turns: days since 1970, twenty of them long; one in three customers' orders are of each speaker.
_T = """t AS (SELECT o_custkey AS file, epoch(o_orderdate) / 86400 AS a, epoch(o_orderdate) / 86400 + 20 AS b, 's' || o_orderkey % 3 AS speaker FROM orders),
    h AS (SELECT o_custkey AS file, epoch(o_orderdate) / 86400 + 5 AS a, epoch(o_orderdate) / 86400 + 30 AS b, 'h' || o_orderkey % 4 AS speaker FROM orders),
    w AS (SELECT o_custkey AS file, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS uid, epoch(l_shipdate) / 86400 AS a, epoch(l_shipdate) / 86400 + 1 AS b, CASE WHEN l_suppkey % 6 > 0 THEN 'h' || l_suppkey % 4 END AS label
      FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)"""
WIDE = 365.0
START, END = 10_400.0, 11_000.0


def _day(c: str) -> F.Column:
    return F.unix_timestamp(c) / 86_400.0


def turns(spark: SparkSession, sf_dir: str, shift: float = 0.0, length: float = 20.0, name: str = "s", n: int = 3) -> DataFrame:
    at = _day("o_orderdate") + shift
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("file"), at.alias("start"), (at + length).alias("end"), F.concat(F.lit(name), (F.col("o_orderkey") % n).cast("string")).alias("speaker")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir, 5.0, 25.0, "h", 4)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").distinct()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("file"))
    label = F.when(F.col("l_suppkey") % 6 > 0, F.concat(F.lit("h"), (F.col("l_suppkey") % 4).cast("string")))
    uid = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.join(o, "l_orderkey").select("file", uid.alias("uid"), _day("l_shipdate").alias("start"), (_day("l_shipdate") + 1).alias("end"), label.alias("label"))


@registry.query(f"WITH {_T} SELECT file, count(DISTINCT speaker) AS speakers, round(max(b), 1) AS duration, round(sum(b - a), 1) AS speech FROM t GROUP BY 1")
def file_survey(spark, sf_dir):
    return reports.survey(turns(spark, sf_dir))


@registry.query(f"""WITH {_T}, s AS (SELECT file, count(DISTINCT speaker) AS speakers, round(max(b), 1) AS duration FROM t GROUP BY 1)
    SELECT speakers, arg_min(file, (-duration, file)) AS file FROM s WHERE speakers <= 8 AND duration >= 10500 GROUP BY 1""")
def chosen_files(spark, sf_dir):
    return reports.chosen_files(reports.survey(turns(spark, sf_dir)), 10_500.0, 8)


_W = "d AS (SELECT c_custkey AS file, 400 + c_custkey % 900 AS duration FROM customer), win AS (SELECT file, k * 180.0::DOUBLE AS a, k * 180.0::DOUBLE + 600 AS b FROM d, generate_series(0, 10) g(k) WHERE k * 180 + 600 <= duration)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), (F.lit(400) + F.col("c_custkey") % 900).alias("duration"))
    return reports.candidate_windows(c, 600.0, 180.0)


@registry.query(f"""WITH {_W} SELECT file, a AS start, b AS "end" FROM win""")
def candidate_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@registry.query(f"""WITH {_T}, {_W}, x AS (SELECT file, a + 10400 AS a, b + 10400 AS b FROM win)
    SELECT x.file, x.a AS start, speaker, sum(least(x.b, t.b) - greatest(x.a, t.a)) AS seconds FROM x JOIN t ON x.file = t.file AND x.a < t.b AND t.a < x.b GROUP BY ALL""")
def window_speech(spark, sf_dir):
    w = _windows(spark, sf_dir).withColumn("start", F.col("start") + START).withColumn("end", F.col("end") + START)
    return reports.speech_per_speaker(turns(spark, sf_dir), w, WIDE)


@registry.query(f"""WITH {_T}, c AS (SELECT file, speaker, sum(least(b, 11000) - greatest(a, 10400)) AS s FROM t WHERE least(b, 11000) > greatest(a, 10400) GROUP BY ALL) SELECT file, count(*) AS speakers FROM c WHERE s >= 30 GROUP BY 1""")
def speakers_in_range(spark, sf_dir):
    return reports.speakers_in(turns(spark, sf_dir), F.lit(START), F.lit(END), 30.0)


@registry.query(f"""WITH {_T}, r AS (SELECT file, speaker, greatest(a, 10400) AS a, least(b, 11000) AS b FROM t WHERE least(b, 11000) > greatest(a, 10400)), g AS (SELECT file, speaker, greatest(a, 10400) AS a, least(b, 11000) AS b FROM h WHERE least(b, 11000) > greatest(a, 10400)),
    n AS (SELECT r.file, r.speaker, g.speaker AS label, sum(least(r.b, g.b) - greatest(r.a, g.a)) AS s FROM r JOIN g ON r.file = g.file AND r.a < g.b AND g.a < r.b GROUP BY ALL), m AS (SELECT file, speaker, arg_min(label, (-s, label)) AS label FROM n GROUP BY ALL)
    SELECT DISTINCT r.file, r.speaker, m.label FROM r LEFT JOIN m ON m.file = r.file AND m.speaker = r.speaker""")
def majority_labels(spark, sf_dir):
    return reports.majority_labels(turns(spark, sf_dir), labels(spark, sf_dir), F.lit(START), F.lit(END), WIDE)


_R = f"""{_T}, ref AS (SELECT w.file, w.uid, arg_min(t.speaker, (greatest(w.a, t.a) - least(w.b, t.b), t.a, t.b, t.speaker)) AS reference FROM w JOIN t ON w.file = t.file AND w.a < t.b AND t.a < w.b GROUP BY ALL)"""


@registry.query(f"WITH {_R} SELECT * FROM ref")
def reference_speakers_at(spark, sf_dir):
    return reports.reference_at(words(spark, sf_dir), turns(spark, sf_dir), WIDE)


_D = f"""{_R}, hw AS (SELECT w.*, reference, least(floor((a + b) / 2 / 200), 65)::BIGINT AS bin FROM w JOIN ref ON ref.file = w.file AND ref.uid = w.uid WHERE b <= 13000)"""


@registry.query(f"""WITH {_D}, n AS (SELECT file % 10 AS file, reference, bin, label, count(*) AS n FROM hw WHERE label IS NOT NULL GROUP BY ALL), m AS (SELECT file, reference, bin, arg_min(label, (-n, label)) AS label, sum(n)::BIGINT AS words FROM n GROUP BY ALL HAVING sum(n) >= 5),
    l AS (SELECT *, lag(label) OVER (PARTITION BY file, reference ORDER BY bin) AS before FROM m) SELECT *, coalesce(before <> label, false) AS swapped FROM l""")
def drift_majorities(spark, sf_dir):
    """Ten customers share a file, so that bins hold words enough."""
    w = words(spark, sf_dir)
    heard = reports.reference_at(w, turns(spark, sf_dir), WIDE)
    ten = w.join(heard, ["file", "uid"]).withColumn("file", F.col("file") % 10)
    return reports.drift_majorities(ten, 200.0, 13_000.0)[0]


@registry.query(f"WITH {_D} SELECT file, bin, count(label) AS labelled, count(*) - count(label) AS unlabelled FROM hw GROUP BY ALL")
def drift_totals(spark, sf_dir):
    return reports.drift_bins(words(spark, sf_dir), turns(spark, sf_dir), 200.0, 13_000.0, WIDE)[1]


@registry.query(f"""WITH {_T}, span AS (SELECT file, min(a) AS pa, max(b) AS pb FROM h GROUP BY 1), i AS (SELECT t.file, speaker AS raw, sum(greatest(0.0, least(b, pb) - greatest(a, pa))) AS inside FROM t JOIN span ON span.file = t.file GROUP BY ALL),
    v AS (SELECT t.file, t.speaker AS raw, h.speaker AS label, sum(least(t.b, h.b) - greatest(t.a, h.a)) AS s FROM t JOIN h ON t.file = h.file AND t.a < h.b AND h.a < t.b GROUP BY ALL)
    SELECT v.file, v.raw, label, round(least(1.0, s / inside), 9) AS fraction FROM v JOIN i ON i.file = v.file AND i.raw = v.raw WHERE inside > 0""")
def overlap_fractions(spark, sf_dir):
    c, p = turns(spark, sf_dir).withColumnRenamed("speaker", "raw"), labels(spark, sf_dir).withColumnRenamed("speaker", "label")
    return reports.overlap_fractions(c, p, ["file"], WIDE).withColumn("fraction", F.round("fraction", 9))


@registry.query(f"WITH {_T} SELECT file, speaker AS raw, sum(b - a) AS duration, min(a) AS first_start, count(*) AS segments FROM t GROUP BY ALL")
def raw_clusters(spark, sf_dir):
    return reports.raw_clusters(turns(spark, sf_dir).withColumnRenamed("speaker", "raw"), ["file"])


@registry.query(f"WITH {_T}, c AS (SELECT file, speaker AS raw, min(a) AS f FROM t GROUP BY ALL) SELECT file, raw, row_number() OVER (PARTITION BY file ORDER BY f, raw) - 1 AS speaker FROM c")
def speaker_seniority(spark, sf_dir):
    c = reports.raw_clusters(turns(spark, sf_dir).withColumnRenamed("speaker", "raw"), ["file"])
    return reports.seniority(c, ["file"]).select("file", "raw", F.col("speaker").cast("long").alias("speaker"))


@registry.query("SELECT o_custkey AS room, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS chunks FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' GROUP BY 1")
def chunks_before(spark, sf_dir):
    ledger = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("room"), F.col("o_orderdate").alias("start"), F.col("o_orderkey").alias("chunk"))
    return reports.chunks_before(ledger, ["room"], F.lit("1998-06-01").cast("timestamp_ntz"))


@registry.query("""SELECT s_suppkey AS file, round((s_nationkey + s_suppkey % 7 + s_suppkey % 3) / CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE s_suppkey % 11 END::DOUBLE, 4) AS value, round(s_nationkey / CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE s_suppkey % 11 END::DOUBLE, 4) AS missed FROM supplier""")
def normalised_errors(spark, sf_dir):
    k = F.col("s_suppkey")
    e = table(spark, sf_dir, "supplier").select(k.alias("file"), F.col("s_nationkey").cast("double").alias("missed"), (k % 7).cast("double").alias("false_alarm"), (k % 3).cast("double").alias("confusion"), (k % 11).cast("double").alias("total"))
    return reports.normalised(e).select("file", "value", "missed")


@registry.query("""WITH f AS (SELECT p_size % 6 AS speaking, p_size % 7 AS used, p_size % 9 AS minted, p_size % 5 AS settled FROM part)
    SELECT round(avg(abs(used - speaking)), 3) AS count_error, round(avg((abs(used - speaking) <= 1)::INTEGER), 3) AS within_one, round(avg((used = speaking)::INTEGER), 3) AS exact, round(avg(used - speaking), 3) AS signed_error,
    round(avg(minted / greatest(1, speaking)), 3) AS minted_per_speaker, round(avg(settled / greatest(1, speaking)), 3) AS settled_per_speaker, round(avg((abs(settled - speaking) <= 1)::INTEGER), 3) AS settled_within_one, round(avg((settled = speaking)::INTEGER), 3) AS settled_exact FROM f""")
def count_report(spark, sf_dir):
    s = F.col("p_size")
    return reports.count_report(table(spark, sf_dir, "part").select((s % 6).alias("speaking"), (s % 7).alias("used"), (s % 9).alias("minted"), (s % 5).alias("settled")))


@registry.query("""WITH s AS (SELECT l_orderkey AS file, l_quantity::DOUBLE AS own, l_linenumber * 5.0::DOUBLE AS other, least(l_quantity, l_linenumber * 5) / 2::DOUBLE AS overlap FROM lineitem)
    SELECT file, round(avg(1 - coalesce(overlap / nullif(own + other - overlap, 0), 0)), 9) AS jer FROM s GROUP BY 1""")
def jaccard_errors(spark, sf_dir):
    own, other = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 5.0
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), own.alias("own"), other.alias("other"), (F.least(own, other) / 2).alias("overlap"))
    return reports.jaccard_error(s).withColumn("jer", F.round("jer", 9))


#: Questions: ten days each, one a year of a customer, with nothing in common.
_Q = """q AS (SELECT c_custkey AS file, k AS uid, 10000 + k * 365.0::DOUBLE AS a, 10010 + k * 365.0::DOUBLE AS b FROM customer, generate_series(0, 4) g(k))"""


@registry.query(f"""WITH {_T}, {_Q}, seen AS (SELECT q.file, uid, speaker AS label, sum(least(q.b, h.b) - greatest(q.a, h.a)) AS s FROM q JOIN h ON q.file = h.file AND q.a < h.b AND h.a < q.b GROUP BY ALL),
    told AS (SELECT file, speaker AS label, sum(b - a) AS t FROM h GROUP BY ALL), lec AS (SELECT told.file, told.label, t - coalesce(q, 0) AS rest FROM told LEFT JOIN (SELECT file, label, sum(s) AS q FROM seen GROUP BY ALL) x ON x.file = told.file AND x.label = told.label),
    ins AS (SELECT file, arg_min(label, (-rest, label)) AS instructor FROM lec WHERE rest > 1e-9 GROUP BY 1), top AS (SELECT file, uid, arg_min(label, (-s, label)) AS label FROM seen GROUP BY ALL)
    SELECT q.file, q.uid, top.label, CASE WHEN top.label IS NULL THEN 'unlabelled' WHEN top.label = instructor THEN 'instructor' ELSE 'own' END AS verdict, coalesce(seen.s, 0) AS as_instructor
    FROM q LEFT JOIN top ON top.file = q.file AND top.uid = q.uid LEFT JOIN ins ON ins.file = q.file LEFT JOIN seen ON seen.file = q.file AND seen.uid = q.uid AND seen.label = instructor""")
def question_verdicts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("uid"))
    asked = c.withColumn("start", 10_000 + F.col("uid") * 365.0).withColumn("end", F.col("start") + 10)
    return reports.questions(labels(spark, sf_dir), asked, WIDE)


_K = "k AS (SELECT user_id AS run, avg(epoch(ts)) AS at FROM events GROUP BY 1), e AS (SELECT user_id AS run, epoch(ts) AS at, event_type FROM events)"


@registry.query(f"""WITH {_K} SELECT k.run, round(min(CASE WHEN e.at > k.at THEN e.at END) - any_value(k.at), 2) AS captions_after, round(min(CASE WHEN e.at > k.at THEN e.at END) - max(CASE WHEN e.at <= k.at THEN e.at END), 2) AS gap,
    round(min(CASE WHEN e.at > k.at AND event_type = 'view' THEN e.at - k.at END), 2) AS labels_after, round(min(CASE WHEN e.at > k.at AND event_type = 'view' AND e.at - 60 >= k.at THEN e.at - k.at END), 2) AS new_audio_after,
    count(*) FILTER (e.at > k.at AND event_type = 'view') AS labels_since FROM k JOIN e ON e.run = k.run GROUP BY k.run""")
def recovery_after_kill(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), at.alias("at"), "event_type")
    killed = e.groupBy("run").agg(F.avg("at").alias("at")).withColumn("stream_at", F.col("at"))
    return reports.recovery(e, e.where("event_type = 'view'").withColumn("audio_end", F.col("at") - 60), killed)


@registry.query("SELECT name, round(coalesce(v, 0), 3) AS total FROM (VALUES ('error'), ('view'), ('nothing')) n(name) LEFT JOIN (SELECT event_type, sum(value) AS v FROM events GROUP BY 1) ON event_type = name")
def counter_summary(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value")
    return reports.counter_summary(s, ["error", "view", "nothing"])


_B = "b AS (SELECT event_type AS name, user_id::VARCHAR AS labels, count(*) AS count, max(value) AS greatest FROM events GROUP BY ALL)"


@registry.query(f"WITH {_B} SELECT name, max(count) AS count, arg_min(greatest, (-count, labels)) AS greatest FROM b WHERE name IN ('error', 'click') GROUP BY 1")
def busiest_histograms(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("labels")).agg(F.count("*").alias("count"), F.max("value").alias("greatest"))
    return reports.busiest_histogram(s, ["error", "click"], ["count", "greatest"])


@registry.query("SELECT count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95 FROM (SELECT value AS v FROM events WHERE user_id % 2 = 0 UNION ALL SELECT value + 1 FROM events WHERE user_id % 2 <> 0)")
def pooled_latency(spark, sf_dir):
    from tidemark.operators.metrics import summary

    e = table(spark, sf_dir, "events")
    even, odd = e.where("user_id % 2 = 0").select("value"), e.where("user_id % 2 <> 0").select((F.col("value") + 1).alias("value"))
    return summary(reports.pooled([even, odd], "value"), [], "value").select("n", "p50", "p95")


@registry.query("""WITH s AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS chunks, count(*) AS messages, count(*) FILTER (l_returnflag = 'R') AS finals, sum(l_linenumber)::BIGINT AS words, count(*) FILTER (l_discount > 0.095) AS errors FROM lineitem GROUP BY 1),
    c AS (SELECT s_nationkey * 3 AS percent FROM supplier)
    SELECT count(*) AS sessions, sum(chunks)::BIGINT AS chunks, sum(messages)::BIGINT AS messages, sum(finals)::BIGINT AS finals, sum(words)::BIGINT AS words, round(sum(messages) / sum(chunks) * 1000, 1) AS transcripts_per_1000, round(sum(words) / sum(chunks) * 1000, 1) AS words_per_1000,
    count(*) FILTER (errors > 0 OR messages = 0) AS failures, (SELECT max(percent) FROM c) AS cpu_max, (SELECT round(avg(percent), 1) FROM c) AS cpu_mean, round((SELECT avg(percent) FROM c) / 100 / count(*), 2) AS cores_per_session, count(*) FILTER (errors > 0 OR messages = 0) = 0 AS ok FROM s""")
def load_test_summary(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("long").alias("chunks"), F.count("*").alias("messages"), F.count_if(F.col("l_returnflag") == "R").alias("finals"),
        F.sum("l_linenumber").cast("long").alias("words"), F.count_if(F.col("l_discount") > 0.095).alias("errors"),
    )
    return reports.load_summary(s, table(spark, sf_dir, "supplier").select((F.col("s_nationkey") * 3).alias("percent")))


@registry.query("""SELECT s_suppkey AS machine, array_to_string(list_filter([CASE WHEN s_suppkey % 4 > 0 THEN 'swap' END, CASE WHEN s_nationkey > 8 * 0.75 THEN 'load' END, CASE WHEN s_acctbal < 3072 THEN 'memory' END], lambda x: x IS NOT NULL), ',') AS warnings,
    s_suppkey % 4 = 0 AND s_nationkey <= 6 AND s_acctbal >= 3072 AS clean FROM supplier""")
def machine_hygiene(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("machine"), (F.col("s_suppkey") % 4).alias("swap_mb"), F.col("s_nationkey").alias("load"), F.lit(8).alias("cpus"), F.col("s_acctbal").alias("free_mb"))
    return reports.hygiene(m).select("machine", F.array_join("warnings", ",").alias("warnings"), "clean")


@registry.query("""WITH t AS (SELECT p_partkey AS name, 'm' || p_partkey % 25 AS metric, p_partkey % 4 AS kind, p_size FROM part), m AS (SELECT 'm' || n_nationkey AS metric, n_nationkey::DOUBLE AS value FROM nation WHERE n_nationkey < 22),
    x AS (SELECT t.*, m.value, o.value AS other FROM t LEFT JOIN m USING (metric) LEFT JOIN m o ON o.metric = 'm' || t.p_size % 25),
    y AS (SELECT name, value, CASE kind WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN other * 1.5 + 1 ELSE other + 2 END::DOUBLE AS l, CASE kind WHEN 0 THEN value BETWEEN p_size - 10 AND p_size WHEN 1 THEN value >= p_size WHEN 2 THEN value <= other * 1.5 + 1 ELSE value <= other + 2 END AS ok FROM x)
    SELECT name, value, l AS limit, CASE WHEN ok IS NULL THEN 'SKIPPED' WHEN ok THEN 'PASS' ELSE 'MISSED' END AS status FROM y""")
def acceptance_targets(spark, sf_dir):
    m = table(spark, sf_dir, "nation").where("n_nationkey < 22").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("metric"), F.col("n_nationkey").cast("double").alias("value"))
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    name = lambda c: F.concat(F.lit("m"), (F.col(c) % 25).cast("string"))
    t = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("name"), name("p_partkey").alias("metric"), F.when(kind == 0, size).alias("max"), F.when(kind == 0, size - 10).when(kind == 1, size).alias("min"),
        F.when(kind == 2, name("p_size")).alias("relative_to"), F.lit(1.5).alias("ratio"), F.lit(1.0).alias("plus"), F.when(kind == 3, name("p_size")).alias("vs_baseline"), F.lit(2.0).alias("slack"),
    )
    return reports.acceptance(t, m, m)
