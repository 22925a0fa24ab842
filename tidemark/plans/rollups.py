"""Rollup queries: users are nodes, suppliers hosts, lineitems stages and job executions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rollups
from tidemark.plans.register import Registry, table

registry = Registry()

#: A user's views are accepted tokens, errors invalid ones, the rest of other reasons; k over 97 is a registration for an ended session.
_N = """n AS (SELECT user_id AS node, count(*) FILTER (event_type = 'view') AS successes, count(*) FILTER (event_type IN ('error', 'click')) AS failures,
    count(*) FILTER (event_type = 'error') AS invalid, count(*) FILTER (event_type = 'signup') AS timeouts,
    CASE WHEN count(*) FILTER (event_type IN ('error', 'click')) = 0 THEN NULL WHEN count(*) FILTER (event_type = 'error') >= count(*) FILTER (event_type = 'click') THEN 'invalid-token' ELSE 'token-expired' END AS dominant,
    count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) > 97) AS ended FROM events GROUP BY 1),
  nf AS (SELECT node, 'auth-never-succeeded' AS id, 'error' AS level, CASE WHEN invalid = failures THEN 'signing-key' ELSE coalesce(dominant, 'rejected') END AS cause FROM n WHERE failures > 0 AND successes = 0
    UNION ALL SELECT node, 'auth-reject-ratio', 'warning', round(failures::DOUBLE / (failures + successes) * 100::DOUBLE)::INTEGER::VARCHAR FROM n WHERE successes > 0 AND failures > 0 AND failures >= 0.5 * (failures + successes)
    UNION ALL SELECT node, 'ended-session-registrations', 'warning', ended::VARCHAR FROM n WHERE ended > 0)"""
_H = """h AS (SELECT s_nationkey AS host, count(*) FILTER (s_acctbal < 0) AS rejects, list_sort(list_distinct(list(CASE s_suppkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'small' ELSE 'turbo' END))) AS providers FROM supplier GROUP BY 1),
  hf AS (SELECT host, 'invalid-provider-key' AS id, 'error' AS level, array_to_string(providers, ', ') AS cause FROM h WHERE rejects > 0)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    error, click = F.count_if(kind == "error"), F.count_if(kind == "click")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(
        F.count_if(kind == "view").alias("successes"), F.count_if(kind.isin("error", "click")).alias("failures"), error.alias("invalid"),
        F.count_if(kind == "signup").alias("timeouts"),
        F.when(error + click == 0, None).when(error >= click, "invalid-token").otherwise("token-expired").alias("dominant"), F.count_if(k > 97).alias("ended"),
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey") % 3
    name = F.when(key == 0, "base").when(key == 1, "small").otherwise("turbo")
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("host")).agg(F.count_if(F.col("s_acctbal") < 0).alias("rejects"), F.collect_set(name).alias("providers"))


@registry.query(f"WITH {_N} SELECT * FROM nf")
def node_findings(spark, sf_dir):
    return rollups.node_findings(nodes(spark, sf_dir))


@registry.query(f"WITH {_H} SELECT * FROM hf")
def host_findings(spark, sf_dir):
    return rollups.host_findings(hosts(spark, sf_dir))


@registry.query(f"""WITH {_N}, {_H} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM h) AS hosts, (SELECT sum(successes)::BIGINT FROM n) AS auth_success, (SELECT sum(failures)::BIGINT FROM n) AS auth_failure,
    (SELECT sum(timeouts)::BIGINT FROM n) AS auth_timeouts, (SELECT count(*) FROM events WHERE user_id % 2 = 0) AS source_closes, (SELECT count(*) FROM events WHERE user_id % 2 <> 0) AS client_closes,
    (SELECT count(*) FROM nf) + (SELECT count(*) FROM hf) AS findings""")
def diagnostics_rollup(spark, sf_dir):
    closes = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "source").otherwise("client").alias("role"), F.lit(1).cast("long").alias("n"))
    return rollups.diagnostics_rollup(nodes(spark, sf_dir), closes, hosts(spark, sf_dir))


#: Stages of an order: depth by line, metered where it was taxed, a detector at a discount of 5 in 100 or more, seconds where returned.
_ST = "st AS (SELECT l_orderkey AS session, l_linenumber AS depth, 'p' || l_partkey AS stage, l_tax, l_discount, l_quantity, l_returnflag FROM lineitem)"


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("depth"), stage.alias("stage"), "l_tax", "l_discount", "l_quantity", "l_returnflag")


@registry.query(f"WITH {_ST} SELECT session, depth, list_sort(list(stage)) AS stages FROM st GROUP BY 1, 2")
def stages_by_depth(spark, sf_dir):
    return rollups.stages_by_depth(stages(spark, sf_dir), "session")


@registry.query(f"WITH {_ST} SELECT session, arg_min(stage, (depth, stage)) AS stage FROM st WHERE l_tax > 0.02 GROUP BY 1")
def headline_stages(spark, sf_dir):
    return rollups.first_stage(stages(spark, sf_dir), "session", F.col("l_tax") > 0.02, "l_tax").drop("value")


@registry.query(f"WITH {_ST} SELECT session, arg_min(stage, (depth, stage)) AS stage FROM st WHERE l_discount >= 0.05 GROUP BY 1")
def vad_stages(spark, sf_dir):
    return rollups.first_stage(stages(spark, sf_dir), "session", F.col("l_discount") >= 0.05, "l_discount").drop("value")


@registry.query(f"WITH {_ST} SELECT session, arg_min(stage, (depth, stage, l_quantity)) AS stage, arg_min(l_quantity, (depth, stage, l_quantity)) AS value FROM st WHERE l_returnflag <> 'N' GROUP BY 1")
def source_throughput(spark, sf_dir):
    seconds = stages(spark, sf_dir).withColumn("stage", F.struct("stage", "l_quantity"))
    got = rollups.first_stage(seconds, "session", F.col("l_returnflag") != "N", "l_quantity")
    return got.select("session", "stage.stage", "value")


@registry.query("""SELECT event_type, count(*) AS samples, count(*) FILTER (user_id % 5 = 0) AS unavailable, count(*) FILTER (user_id % 5 > 0 AND value < 1) AS negative FROM events GROUP BY 1""")
def latency_outcomes(spark, sf_dir):
    outcome = F.when(F.col("user_id") % 5 == 0, "unavailable").when(F.col("value") < 1, "negative").otherwise("ok")
    return rollups.outcomes(table(spark, sf_dir, "events").withColumn("outcome", outcome), ["event_type"])


_L = """l AS (SELECT user_id, event_type AS kind, event_id, 'pipeline' AS measure, value FROM events UNION ALL SELECT user_id, event_type, event_id, 'e2e', value - 1 FROM events WHERE user_id % 5 > 0 AND value >= 1)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e2e = F.when(F.col("user_id") % 5 != 0, F.col("value") - 1)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), F.col("value").alias("pipeline"), e2e.alias("e2e"))


@registry.query(f"""WITH {_L}, k AS (SELECT *, row_number() OVER (PARTITION BY measure, kind ORDER BY event_id DESC) AS k FROM l)
    SELECT measure, kind, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS greatest FROM k WHERE k <= 4096 GROUP BY 1, 2""")
def process_latency_series(spark, sf_dir):
    return rollups.latency_series(samples(spark, sf_dir), [], ["event_id"], rollups.PROCESS_SAMPLES).select("measure", "kind", "n", "p50", "p95", "greatest")


@registry.query(f"""WITH {_L}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, measure, kind ORDER BY event_id DESC) AS k FROM l)
    SELECT user_id, measure, kind, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM k WHERE k <= 512 GROUP BY 1, 2, 3""")
def session_latency_series(spark, sf_dir):
    return rollups.latency_series(samples(spark, sf_dir), ["user_id"], ["event_id"], rollups.SESSION_SAMPLES).select("user_id", "measure", "kind", "n", "p50", "p95")


@registry.query(f"""WITH {_L}, r AS (SELECT user_id, measure, kind, count(*) AS n FROM l GROUP BY 1, 2, 3)
    SELECT user_id, any_value(total) AS total, string_agg(measure || '/' || kind || '=' || n, ' ' ORDER BY measure, kind) AS series FROM r JOIN (SELECT user_id, count(*) AS total FROM events GROUP BY 1) USING (user_id) GROUP BY 1""")
def node_metrics_snapshot(spark, sf_dir):
    s = rollups.latency_series(samples(spark, sf_dir), ["user_id"], ["event_id"], rollups.PROCESS_SAMPLES)
    counters = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"))
    out = rollups.metrics_snapshot(s, counters, "user_id")
    each = F.transform("latency", lambda x: F.concat(x["measure"], F.lit("/"), x["kind"], F.lit("="), x["n"].cast("string")))
    return out.select("user_id", "total", F.array_join(each, " ").alias("series"))


#: Executions: a shipment is a run of its supplier's provider, diarization for even parts; nanoseconds from quantity and price.
_X = """x AS (SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'unknown' ELSE 'w' || l_suppkey % 5 END AS provider, l_suppkey % 5 > 0 AND l_partkey % 2 = 0 AS diarization, l_quantity * 1000000 AS delay_ns, l_extendedprice * 1000 AS execution_ns,
    l_linenumber - 1 AS audio_seconds, l_returnflag = 'R' AS failed FROM lineitem)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.when(F.col("l_partkey") % 2 == 0, ":diarization").otherwise("")
    label = F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit("w"), (F.col("l_suppkey") % 5).cast("string"), even)).otherwise("")
    return table(spark, sf_dir, "lineitem").select(
        label.alias("label"), (F.col("l_quantity").cast("double") * 1_000_000).alias("delay_ns"), (F.col("l_extendedprice").cast("double") * 1000).alias("execution_ns"),
        (F.col("l_linenumber") - 1).alias("audio_seconds"), (F.col("l_returnflag") == "R").alias("failed"), "l_linestatus", "l_discount",
    )


@registry.query(f"""WITH {_X} SELECT provider, diarization, count(*) AS runs, round(avg(delay_ns / 1e6), 6) AS delay_ms, round(avg(execution_ns / 1e6), 6) AS execution_ms, max(execution_ns / 1e6) AS slowest_ms,
    round(avg(CASE WHEN audio_seconds > 0 THEN execution_ns / 1e9 / audio_seconds END), 9) AS real_time_factor, count(*) FILTER (failed) AS failed FROM x GROUP BY 1, 2""")
def job_executions(spark, sf_dir):
    out = rollups.executions(jobs(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("delay_ms", "execution_ms")}).withColumn("real_time_factor", F.round("real_time_factor", 9))


@registry.query(f"WITH {_X} SELECT diarization, provider, count(*) AS runs FROM x GROUP BY ALL")
def split_job_labels(spark, sf_dir):
    return rollups.split_executions(jobs(spark, sf_dir)).groupBy("diarization", "provider").agg(F.count("*").alias("runs"))


@registry.query("SELECT user_id, event_type AS name, round(sum(value), 4) AS total FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL")
def worker_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), F.col("value").alias("delta"))
    return rollups.known_counters(e, ["error", "purchase", "nobody"], ["user_id"]).withColumn("total", F.round("total", 4))


_W = "w AS (SELECT s_suppkey AS worker, s_nationkey AS clean_samples, s_acctbal / 50000 AS cost FROM supplier)"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), F.col("s_nationkey").alias("clean_samples"), (F.col("s_acctbal") / 50000).alias("cost"))


@registry.query(f"WITH {_W} SELECT worker, CASE WHEN clean_samples >= 5 THEN greatest(coalesce(floor(0.85 / CASE WHEN cost > 0 THEN cost END), 1), 1)::BIGINT END AS capacity FROM w")
def worker_capacity(spark, sf_dir):
    return rollups.capacity(measured(spark, sf_dir), 0.85, 1)


@registry.query(f"""WITH {_W}, c AS (SELECT worker, CASE WHEN clean_samples >= 5 THEN greatest(coalesce(floor(0.85 / CASE WHEN cost > 0 THEN cost END), 1), 1)::BIGINT END AS capacity FROM w)
    SELECT worker, worker % 9 = 0 OR capacity IS NULL OR worker % 9 + 1 <= capacity AS admits FROM c""")
def worker_admission(spark, sf_dir):
    return rollups.capacity(measured(spark, sf_dir), 0.85, 1).select("worker", rollups.admits(F.col("worker") % 9, F.col("capacity")).alias("admits"))


@registry.query("""WITH s AS (SELECT user_id, event_id, value AS total, CASE WHEN event_type = 'view' THEN value ELSE 0 END AS idle FROM events),
    a AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after_ FROM s)
    SELECT user_id, round(1 - sum(idle) / nullif(sum(total), 0), 6) AS utilization FROM a WHERE after_ < 60 GROUP BY 1""")
def rolling_utilization(spark, sf_dir):
    idle = F.when(F.col("event_type") == "view", F.col("value")).otherwise(0.0)
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("total"), idle.alias("idle"))
    return rollups.utilization(steps, ["user_id"], "event_id", 60.0).withColumn("utilization", F.round("utilization", 6))
