"""Fleet queries: suppliers are hosts, nations providers, regions a stage graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fleet
from tidemark.plans.register import Registry, table

registry = Registry()


@registry.query("""SELECT user_id, max(event_id) AS event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00') GROUP BY user_id""")
def live_members(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    index = e.groupBy(F.col("user_id").alias("member")).agg(F.unix_timestamp(F.max("ts")).cast("double").alias("score"))
    values = e.groupBy(F.col("user_id").alias("member")).agg(F.max("event_id").alias("event_id"))
    now = F.unix_timestamp(F.lit("2024-01-31").cast("timestamp_ntz")).cast("double")
    return fleet.live(index, values, "member", "score", now, 43_200.0).select(F.col("member").alias("user_id"), "event_id")


@registry.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parsed_snapshots(spark, sf_dir):
    good, _ = fleet.parsed(table(spark, sf_dir, "events"), "props", "k long")
    return good.select("event_id", "body.k")


@registry.query("""SELECT n_name AS provider, sum(s_suppkey % 7)::BIGINT AS sessions, CASE min(s_suppkey % 3) WHEN 0 THEN 'ok' WHEN 1 THEN 'degraded' ELSE 'down' END AS status, count(*) AS hosts,
    CASE WHEN count(*) = count(CASE WHEN s_acctbal > 0 THEN 1 END) THEN (4 * count(*))::BIGINT END AS capacity FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name""")
def merged_providers(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    status = F.element_at(F.array(F.lit("ok"), F.lit("degraded"), F.lit("down")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    hosts = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("n_name").alias("provider"), F.col("s_name").alias("host"), (F.col("s_suppkey") % 7).alias("sessions"), status.alias("status"),
        F.when(F.col("s_acctbal") > 0, 4).cast("long").alias("capacity"),
    )
    return fleet.merge_providers(hosts).select("provider", "sessions", "status", F.size("hosts").cast("long").alias("hosts"), "capacity")


@registry.query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' WHEN s_nationkey > 20 THEN 'crit' WHEN s_nationkey >= 17 THEN 'warn' ELSE 'good' END AS status FROM supplier""")
def capacity_statuses(spark, sf_dir):
    cap = F.when(F.col("s_suppkey") % 5 != 0, F.lit(20))
    return table(spark, sf_dir, "supplier").select("s_suppkey", fleet.capacity_status(F.col("s_nationkey"), cap).alias("status"))


@registry.query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'crit' WHEN s_suppkey % 4 = 0 THEN 'unknown' WHEN s_nationkey - 60 < -45 OR s_acctbal / 500 < 10 THEN 'warn' ELSE 'good' END AS status FROM supplier""")
def audio_statuses(spark, sf_dir):
    level = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey") - 60)
    return table(spark, sf_dir, "supplier").select("s_suppkey", fleet.audio_status(F.col("s_acctbal") < 0, F.lit(0.0), level, F.col("s_acctbal") / 500).alias("status"))


@registry.query("SELECT count(*) AS n, count(*) FILTER (s_acctbal < -900) AS dead, count(*) FILTER (s_nationkey >= 20 AND s_suppkey % 2 > 0) AS full, CASE WHEN count(*) = 0 OR count(*) FILTER (s_acctbal < -900) > 0 THEN 'not_ready' WHEN count(*) FILTER (s_nationkey >= 20 AND s_suppkey % 2 > 0) = count(*) THEN 'degraded' ELSE 'ready' END AS state FROM supplier")
def fleet_readiness(spark, sf_dir):
    w = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") >= -900).alias("alive"), F.col("s_nationkey").alias("utilization"), (F.col("s_suppkey") % 2).alias("live_jobs"))
    return fleet.readiness(w, 20)


@registry.query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
    v AS (SELECT parent AS stage FROM e UNION SELECT child FROM e), d AS (SELECT stage, 1 AS depth FROM v WHERE stage NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.stage)
    SELECT stage, max(depth)::INTEGER AS depth FROM d GROUP BY stage""")
def stage_depths(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(
        s.select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("child"))
    ).distinct()
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("stage")).distinct()
    return fleet.stage_depths(edges, nodes)


@registry.query("""SELECT 'n' || s_nationkey AS input, 's' || s_suppkey AS stage, round(100 - s_acctbal / 100, 4) AS lost, CASE WHEN s_suppkey % 10 = 0 THEN 'gated' WHEN 100 - s_acctbal / 100 > 5 THEN 'loss' ELSE 'within_tolerance' END AS kind FROM supplier""")
def stage_edges(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    stages = s.select(name("s", "s_suppkey").alias("stage"), F.array(name("n", "s_nationkey")).alias("inputs"), (F.col("s_acctbal") / 100).alias("seconds"), (F.col("s_suppkey") % 10 == 0).alias("gate")).unionByName(
        n.select(name("n", "n_nationkey").alias("stage"), F.array().cast("array<string>").alias("inputs"), F.lit(100.0).alias("seconds"), F.lit(False).alias("gate"))
    )
    return fleet.stage_edges(stages).withColumn("lost", F.round("lost", 4))


@registry.query("SELECT 'n' || s_nationkey AS input, 's' || s_suppkey AS stage, round(100 - s_acctbal / 100, 4) AS lost FROM supplier WHERE s_suppkey % 10 > 0 AND 100 - s_acctbal / 100 > 5")
def signal_loss_edges(spark, sf_dir):
    return stage_edges(spark, sf_dir).where("kind = 'loss'").drop("kind")


@registry.query("""SELECT user_id, count(*)::BIGINT AS attempts, count(*) FILTER (event_type <> 'view')::BIGINT AS failures, round(count(*) FILTER (event_type <> 'view') / nullif(count(*), 0), 6) AS failure_ratio FROM events GROUP BY user_id""")
def handshake_tally(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("n", F.lit(1).cast("long"))
    return fleet.handshake_tally(e, ["user_id"], "event_type", "n", ok="view").withColumn("failure_ratio", F.round("failure_ratio", 6))


@registry.query("""SELECT c_custkey, CASE WHEN m IS NULL THEN 'never' WHEN date_diff('day', m, TIMESTAMP '2001-08-02') >= 400 THEN 'crit' WHEN date_diff('day', m, TIMESTAMP '2001-08-02') >= 100 THEN 'warn' ELSE 'good' END AS freshness
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def telemetry_freshness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("m"))
    j = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    day = lambda c: F.unix_timestamp(c) / 86_400
    return j.select("c_custkey", fleet.freshness(day(F.col("m")), day(F.lit("2001-08-02").cast("timestamp_ntz")), 100, 400).alias("freshness"))


@registry.query("SELECT arg_min(s_suppkey, (s_nationkey, s_suppkey)) AS worker_id FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 2 = 0 AND s_suppkey % 3 = 0")
def least_utilised_worker(spark, sf_dir):
    tags = F.array_compact(F.array(F.when(F.col("s_suppkey") % 2 == 0, "a"), F.when(F.col("s_suppkey") % 3 == 0, "b")))
    w = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker_id"), tags.alias("tags"), (F.col("s_acctbal") > 0).alias("alive"), F.col("s_nationkey").alias("utilization"))
    return fleet.least_utilised(w, ["a", "b"])


@registry.query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS job_id FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def earliest_deadline_job(spark, sf_dir):
    j = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("deadline"), F.when(F.col("o_orderstatus") == "O", "READY").otherwise("RUNNING").alias("state"))
    return fleet.earliest_deadline(j, ["o_custkey"])


@registry.query("""SELECT user_id, arg_min(value, (abs(value - 10), -event_id)) AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 8 GROUP BY user_id""")
def clock_offsets(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("offset"), F.abs(F.col("value") - 10).alias("rtt"))
    return fleet.clock_offset(s, ["user_id"], "event_id")
