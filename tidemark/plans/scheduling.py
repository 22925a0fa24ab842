"""Sessions from orders: a customer is a room, an order an interval from its date to its last shipment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intervals, schedule
from tidemark.plans.register import Registry, table

registry = Registry()
DAY = 86_400.0
#: Intervals of the oracle: seconds since 1970.
_S = """s AS (SELECT o_custkey AS room, o_orderkey AS uid, epoch(o_orderdate) AS a, greatest(epoch(o_orderdate) + 86400, coalesce(epoch(max(l_shipdate)), epoch(o_orderdate) + 86400)) AS b
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room, uid, start, end in seconds: from the order to its last shipment, a day at least."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    shipped = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    last = o.select("o_orderkey", "o_orderdate", "o_custkey").join(shipped, "o_orderkey", "left")
    sec = lambda c: F.unix_timestamp(c).cast("double")
    start = sec("o_orderdate")
    return last.select(
        F.col("o_custkey").alias("room"), F.col("o_orderkey").alias("uid"), start.alias("start"),
        F.greatest(start + DAY, F.coalesce(sec("last"), start + DAY)).alias("end"),
    )


@registry.query(f"WITH {_S} SELECT x.room, x.uid AS uid_a, y.uid AS uid_b FROM s x JOIN s y ON x.room = y.room AND x.uid < y.uid AND x.a < y.b AND y.a < x.b")
def overlapping_sessions(spark, sf_dir):
    s = sessions(spark, sf_dir)
    pairs = intervals.overlap_join(s, s, ["room"], 365 * DAY, 4e9).where("l_uid < r_uid")
    return pairs.select("room", F.col("l_uid").alias("uid_a"), F.col("r_uid").alias("uid_b"))


@registry.query(f"WITH {_S} SELECT uid FROM s WHERE a < epoch(TIMESTAMP '1998-02-01') AND b > epoch(TIMESTAMP '1998-01-01')")
def sessions_in_range(spark, sf_dir):
    lo, hi = (F.lit(float(x)) for x in (883612800, 886291200))
    return sessions(spark, sf_dir).where(intervals.overlaps(F.col("start"), F.col("end"), lo, hi)).select("uid")


@registry.query(f"WITH {_S} SELECT uid FROM s WHERE a <= epoch(TIMESTAMP '1998-02-01') AND b >= epoch(TIMESTAMP '1998-01-01')")
def schedules_in_closed_range(spark, sf_dir):
    lo, hi = (F.lit(float(x)) for x in (883612800, 886291200))
    return sessions(spark, sf_dir).where(intervals.overlaps_closed(F.col("start"), F.col("end"), lo, hi)).select("uid")


@registry.query(f"WITH {_S} SELECT room, uid FROM s WHERE a <= 883612800 AND 883612800 < b")
def active_sessions(spark, sf_dir):
    return sessions(spark, sf_dir).where(intervals.active_at(F.col("start"), F.col("end"), F.lit(883612800.0))).select("room", "uid")


@registry.query(f"WITH {_S} SELECT room, uid FROM s WHERE a <= 883612800 AND 883612800 < b OR a > 883612800 AND a <= 884217600")
def active_and_upcoming(spark, sf_dir):
    s, now = sessions(spark, sf_dir), F.lit(883612800.0)
    soon = (F.col("start") > now) & (F.col("start") <= 884217600.0)
    return s.where(intervals.active_at(F.col("start"), F.col("end"), now) | soon).select("room", "uid")


@registry.query(f"WITH {_S} SELECT uid, CASE WHEN 883612800 < a THEN 'UPCOMING' WHEN 883612800 < b THEN 'ACTIVE' ELSE 'ENDED' END AS state FROM s")
def session_states(spark, sf_dir):
    return sessions(spark, sf_dir).select("uid", schedule.state(F.col("start"), F.col("end"), F.lit(883612800.0)).alias("state"))


@registry.query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'NOT_SCHEDULED_TYPE' WHEN o_orderstatus = 'F' THEN 'ALREADY_CANCELED' WHEN o_orderdate <= TIMESTAMP '1998-01-01' THEN 'NOT_UPCOMING' ELSE 'OK' END AS cancel,
    CASE WHEN o_orderstatus = 'F' THEN 'OK' ELSE 'SESSION_NOT_CANCELED' END AS uncancel FROM orders""")
def cancel_verdicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "AUTO").otherwise("SCHEDULED")
    canceled = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    return o.select("o_orderkey", schedule.cancel_verdict(kind, canceled, F.col("o_orderdate"), now).alias("cancel"), schedule.uncancel_verdict(canceled).alias("uncancel"))


@registry.query(f"""WITH {_S}, m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY room ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM s),
    i AS (SELECT *, sum(n) OVER (PARTITION BY room ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT room, min(a)::DOUBLE AS start, max(b)::DOUBLE AS "end" FROM i GROUP BY room, k""")
def merged_intervals(spark, sf_dir):
    return intervals.merged(sessions(spark, sf_dir), ["room"])


@registry.query(f"""WITH {_S}, w AS (SELECT DISTINCT room FROM s), c AS (SELECT room, greatest(a, 883612800) AS a, least(b, 915148800) AS b FROM s WHERE a < 915148800 AND b > 883612800),
    p AS (SELECT room, a, b FROM c UNION ALL SELECT room, 883612800, 883612800 FROM w UNION ALL SELECT room, 915148800, 915148800 FROM w),
    g AS (SELECT room, a, max(b) OVER (PARTITION BY room ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM p) SELECT room, e::DOUBLE AS slot_start, a::DOUBLE AS slot_end FROM g WHERE a - e >= 86400""")
def auto_session_slots(spark, sf_dir):
    s = sessions(spark, sf_dir)
    w = s.select("room").distinct().select("room", F.lit(1).alias("uid"), F.lit(883612800.0).alias("start"), F.lit(915148800.0).alias("end"))
    return intervals.free_slots(w, s, ["room"], DAY).select("room", "slot_start", "slot_end")


@registry.query(f"""WITH {_S}, t AS (SELECT room, tick, sum(d) AS d FROM (SELECT room, a AS tick, 1 AS d FROM s UNION ALL SELECT room, b, -1 FROM s) GROUP BY ALL),
    r AS (SELECT room, tick, sum(d) OVER w AS depth, lead(tick) OVER w AS u FROM t WINDOW w AS (PARTITION BY room ORDER BY tick)) SELECT room, sum(u - tick)::DOUBLE AS seconds FROM r WHERE depth >= 2 AND u IS NOT NULL GROUP BY room""")
def overlap_seconds(spark, sf_dir):
    return intervals.overlap_seconds(sessions(spark, sf_dir), ["room"])


@registry.query(f"""WITH {_S} SELECT x.room, x.uid, sum(least(x.b, y.b) - greatest(x.a, y.a))::DOUBLE AS seconds FROM s x JOIN s y ON x.room = y.room AND x.uid <> y.uid AND x.a < y.b AND y.a < x.b GROUP BY ALL""")
def coverage_by_session(spark, sf_dir):
    s = sessions(spark, sf_dir)
    pairs = intervals.overlap_join(s, s, ["room"], 365 * DAY, 4e9).where("l_uid <> r_uid").withColumnRenamed("l_uid", "uid")
    return intervals.coverage(pairs, ["room", "uid"])


@registry.query(f"""WITH {_S}, p AS (SELECT x.room, x.uid, y.uid AS label, least(x.b, y.b) - greatest(x.a, y.a) AS o FROM s x JOIN s y ON x.room = y.room AND x.uid <> y.uid AND x.a < y.b AND y.a < x.b)
    SELECT room, uid, arg_max(label, (o, -label)) AS label, max(o)::DOUBLE AS seconds FROM p GROUP BY ALL""")
def best_overlapping_session(spark, sf_dir):
    s = sessions(spark, sf_dir)
    pairs = intervals.overlap_join(s, s, ["room"], 365 * DAY, 4e9).where("l_uid <> r_uid")
    pairs = pairs.withColumnsRenamed({"l_uid": "uid", "r_uid": "label"}).withColumn("order", F.col("label"))
    return intervals.best_overlap(pairs, ["room", "uid"], "label", "order")


@registry.query(f"""WITH {_S}, t AS (SELECT room, tick, sum(d) AS d FROM (SELECT room, a AS tick, 1 AS d FROM s UNION ALL SELECT room, b, -1 FROM s) GROUP BY ALL),
    e AS (SELECT room, tick, sum(d) OVER w AS depth, lead(tick) OVER w AS u FROM t WINDOW w AS (PARTITION BY room ORDER BY tick)),
    o AS (SELECT e.room, s.uid, e.tick, e.u FROM e JOIN s ON s.room = e.room AND s.a <= e.tick AND s.b >= e.u WHERE depth = 1 AND u IS NOT NULL),
    m AS (SELECT *, CASE WHEN tick > max(u) OVER (PARTITION BY room, uid ORDER BY tick, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 86400 THEN 1 ELSE 0 END AS n FROM o),
    i AS (SELECT *, sum(n) OVER (PARTITION BY room, uid ORDER BY tick, u ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT room, uid, min(tick)::DOUBLE AS start, max(u)::DOUBLE AS "end" FROM i GROUP BY room, uid, k HAVING max(u) - min(tick) >= 432000""")
def exclusive_runs(spark, sf_dir):
    return intervals.exclusive_runs(sessions(spark, sf_dir), ["room"], "uid", DAY, 5 * DAY).select("room", "uid", "start", "end")


@registry.query(f"""WITH {_S} SELECT room, uid, least(b, lead(a) OVER (PARTITION BY room ORDER BY a, uid))::DOUBLE AS "end" FROM s""")
def realigned_ends(spark, sf_dir):
    from pyspark.sql import Window

    s, w = sessions(spark, sf_dir), Window.partitionBy("room").orderBy("start", "uid")
    return s.select("room", "uid", F.least("end", F.lead("start").over(w)).alias("end"))


@registry.query(f"""WITH {_S}, d AS (SELECT room, uid, a, b FROM s WHERE uid % 3 <> 0), c AS (SELECT room, uid, a, b FROM s WHERE uid % 3 <> 1)
    SELECT coalesce(d.uid, c.uid) AS uid, CASE WHEN d.uid IS NOT NULL AND c.uid IS NOT NULL THEN 'keep' WHEN d.uid IS NOT NULL THEN 'insert' WHEN c.a <= 883612800 AND 883612800 < c.b THEN 'preserve' WHEN c.a > 883612800 THEN 'delete' ELSE 'past' END AS action
    FROM d FULL JOIN c ON d.uid = c.uid AND d.room = c.room AND d.a = c.a AND d.b = c.b""")
def reconcile_sessions(spark, sf_dir):
    s = sessions(spark, sf_dir)
    return schedule.reconcile(s.where("uid % 3 <> 0"), s.where("uid % 3 <> 1"), ["room", "uid"], F.lit(883612800.0)).select("uid", "action")


@registry.query("""WITH d AS (SELECT n_nationkey, n_regionkey, unnest(generate_series(DATE '2024-01-01', DATE '2024-06-30', INTERVAL 1 DAY))::DATE AS day FROM nation)
    SELECT n_nationkey AS uid, strftime(day + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS start_utc, strftime(day + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M') AS end_utc FROM d
    WHERE isodow(day) = n_regionkey % 5 + 1 AND (n_nationkey % 2 = 0 OR date_diff('week', DATE '2024-01-01', day) % 2 = 0)""")
def recurring_occurrences(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    ts = lambda s: F.lit(s).cast("timestamp")
    days = F.array(*map(F.lit, ["MON", "TUE", "WED", "THU", "FRI"]))
    s = n.select(
        F.col("n_nationkey").alias("uid"), F.lit("UTC").alias("timezone"), ts("2024-01-01").alias("anchor_start"), ts("2024-01-01").alias("active_start"),
        ts("2024-07-01").alias("active_end"), F.lit("09:00").alias("local_start_time"), F.lit("10:00:00").alias("local_end_time"),
        F.when(F.col("n_nationkey") % 2 == 0, "WEEKLY").otherwise("BIWEEKLY").alias("frequency"), F.array(F.element_at(days, F.col("n_regionkey") % 5 + 1)).alias("days_of_week"),
    )
    o = schedule.occurrences(s, ts("2024-01-01"), ts("2024-07-01"))
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return o.select("uid", f("start_utc"), f("end_utc"))


@registry.query("""WITH d AS (SELECT n_nationkey AS uid, unnest([TIMESTAMP '2024-03-10 02:30:00', TIMESTAMP '2024-11-03 01:30:00', TIMESTAMP '2024-07-01 12:00:00']) AS l FROM nation)
    SELECT uid, strftime(l, '%Y-%m-%d %H:%M') AS local, CASE l WHEN TIMESTAMP '2024-03-10 02:30:00' THEN '2024-03-10 07:00' WHEN TIMESTAMP '2024-11-03 01:30:00' THEN '2024-11-03 06:30' ELSE '2024-07-01 16:00' END AS utc FROM d""")
def local_to_utc(spark, sf_dir):
    local = F.explode(F.array(*(F.lit(x).cast("timestamp") for x in ("2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-07-01 12:00:00"))))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uid"), local.alias("l"))
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return n.select("uid", f("l").alias("local"), f(schedule.local_to_utc(F.col("l"), F.lit("America/New_York"))).alias("utc"))


@registry.query("SELECT n_nationkey, (date_diff('day', date_trunc('week', DATE '2024-01-01' + n_nationkey), date_trunc('week', DATE '2024-06-01' + 3 * n_nationkey)) // 7)::INTEGER AS weeks FROM nation")
def weeks_between(spark, sf_dir):
    d = lambda s, k: F.date_add(F.lit(s).cast("date"), F.col("n_nationkey") * k)
    return table(spark, sf_dir, "nation").select("n_nationkey", schedule.weeks_between(d("2024-01-01", 1), d("2024-06-01", 3)).alias("weeks"))


@registry.query(f"WITH {_S} SELECT room, max(b)::DOUBLE AS last_end FROM s GROUP BY room")
def max_scheduled_end(spark, sf_dir):
    return sessions(spark, sf_dir).groupBy("room").agg(F.max("end").alias("last_end"))


@registry.query(f"WITH {_S} SELECT room, arg_max(uid, (a, uid)) AS uid FROM s WHERE a <= 883612800 GROUP BY room")
def latest_past_or_active(spark, sf_dir):
    return sessions(spark, sf_dir).where("start <= 883612800").groupBy("room").agg(F.max_by("uid", F.struct("start", "uid")).alias("uid"))


@registry.query("""SELECT o_orderkey, map_from_entries(list_filter([{'key': 'status', 'value': 'X'}, {'key': 'priority', 'value': '2-HIGH'}], lambda e: e.key = 'status' AND o_orderstatus <> 'X' OR e.key = 'priority' AND o_orderpriority <> '2-HIGH'))::VARCHAR AS changed FROM orders""")
def schedule_patch(spark, sf_dir):
    before = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    after = before.select("o_orderkey", F.lit("X").alias("status"), F.lit("2-HIGH").alias("priority"))
    p = schedule.patch(before, after, "o_orderkey", ["status", "priority"])
    pairs = F.transform(F.map_entries("changed"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return p.select("o_orderkey", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("changed"))
