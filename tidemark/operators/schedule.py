"""Recurring local-time schedules as UTC occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shortest session that a clipped occurrence may leave.
LEAST_SECONDS = 60
#: Days that a materialisation looks ahead.
HORIZON_DAYS = 7
DAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")


def local_to_utc(local: Column, zone: Column) -> Column:
    """Instant of a local time: the transition itself for a time that a jump skips, the later of two for one that comes twice."""
    u = F.to_utc_timestamp(local, zone)
    back = F.from_utc_timestamp(u, zone)
    minute = F.expr("INTERVAL 1 MINUTE")
    offset = lambda t: F.unix_timestamp(F.from_utc_timestamp(t, zone)) - F.unix_timestamp(t)
    steps = F.sequence(u - F.expr("INTERVAL 4 HOURS"), u, F.expr("INTERVAL 15 MINUTES"))
    snap = F.array_min(F.filter(steps, lambda t: offset(t) == offset(u)))
    later = lambda n: u + minute * n
    same = lambda n: F.from_utc_timestamp(later(n), zone) == local
    return F.when(back != local, snap).when(same(60), later(60)).when(same(30), later(30)).otherwise(u)


def seconds_of(time: Column) -> Column:
    """Seconds of the day of HH:MM[:SS]."""
    p = F.split(time, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + F.coalesce(F.try_element_at(p, F.lit(3)).cast("int"), F.lit(0))


def weeks_between(a: Column, b: Column) -> Column:
    """Whole weeks from the Monday of a to the Monday of b."""
    return (F.datediff(F.trunc(b, "week"), F.trunc(a, "week")) / 7).cast("int")


def occurrences(schedules: DataFrame, begin: Column, end: Column, least: int = LEAST_SECONDS) -> DataFrame:
    """(uid, start_utc, end_utc) of ONCE, WEEKLY and BIWEEKLY schedules between two instants.

    ``schedules``: uid, timezone, anchor_start, active_start, active_end?, local_start_time,
    local_end_time, frequency, days_of_week. An end at or before the start wraps midnight. Clipping
    to the active range drops what is left shorter than ``least`` seconds.
    """
    s = schedules.withColumn("_anchor", F.to_date(F.from_utc_timestamp("anchor_start", F.col("timezone"))))
    first = F.to_date(F.from_utc_timestamp(F.greatest(begin, F.col("active_start")), F.col("timezone")))
    last = F.to_date(F.from_utc_timestamp(F.least(end, F.coalesce("active_end", end)), F.col("timezone")))
    days = F.when(F.col("frequency") == "ONCE", F.array("_anchor")).otherwise(F.sequence(F.date_sub(first, 1), F.greatest(last, F.date_sub(first, 1))))
    d = s.withColumn("day", F.explode(days))
    name = F.element_at(F.array(*map(F.lit, DAYS)), F.dayofweek("day"))
    weekly = (F.col("day") >= F.col("_anchor")) & F.array_contains("days_of_week", name)
    even = F.pmod(weeks_between(F.col("_anchor"), F.col("day")), F.lit(2)) == 0
    d = d.where((F.col("frequency") == "ONCE") | (F.col("frequency") == "WEEKLY") & weekly | (F.col("frequency") == "BIWEEKLY") & weekly & even)
    a, b = seconds_of(F.col("local_start_time")), seconds_of(F.col("local_end_time"))
    at = lambda sec, plus: F.to_timestamp_ntz(F.date_add("day", plus).cast("string")).cast("timestamp") + F.make_dt_interval(secs=sec)
    start = local_to_utc(at(a, F.lit(0)), F.col("timezone"))
    stop = local_to_utc(at(b, F.when(b <= a, 1).otherwise(0)), F.col("timezone"))
    o = d.withColumn("raw_start", start).withColumn("raw_end", stop).where("raw_start < raw_end")
    o = o.withColumn("start_utc", F.greatest("raw_start", "active_start")).withColumn("end_utc", F.least("raw_end", F.coalesce("active_end", "raw_end")))
    whole = (F.col("start_utc") == F.col("raw_start")) & (F.col("end_utc") == F.col("raw_end"))
    seconds = F.unix_timestamp("end_utc") - F.unix_timestamp("start_utc")
    o = o.where((whole | (seconds >= least)) & (F.col("start_utc") < end) & (F.col("end_utc") > begin))
    return o.select("uid", "start_utc", "end_utc")


def conflicts(occurrence_rows: DataFrame, room: str = "room_uid") -> DataFrame:
    """Pairs of different schedules of a room whose occurrences overlap.

    Sorted by start, an occurrence conflicts with every later one that begins before it ends; a pair
    is found through day buckets.
    """
    from tidemark.operators.intervals import overlap_join

    t = occurrence_rows.select(room, "uid", F.unix_timestamp("start_utc").cast("double").alias("start"), F.unix_timestamp("end_utc").cast("double").alias("end"))
    pairs = overlap_join(t, t, [room], 86_400.0, 4e9).where("l_uid < r_uid")
    return pairs.select(room, F.col("l_uid").alias("uid_a"), F.col("r_uid").alias("uid_b")).distinct()


def reconcile(desired: DataFrame, current: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """What a materialisation does with each slot: keep, insert, delete; running slots are preserved.

    Both frames: keys, start, end (null in none).
    """
    d = desired.select(*keys, "start", "end", F.lit(True).alias("_d"))
    c = current.select(*keys, "start", "end", F.lit(True).alias("_c"))
    j = d.join(c, [*keys, "start", "end"], "full_outer")
    running = (F.col("start") <= now) & (now < F.col("end"))
    action = (
        F.when(F.col("_d") & F.col("_c"), "keep")
        .when(F.col("_d"), "insert")
        .when(running, "preserve")
        .when(F.col("start") > now, "delete")
        .otherwise("past")
    )
    return j.select(*keys, "start", "end", action.alias("action"))


def realigned(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Ends pulled forward to the next start of the key."""
    w = Window.partitionBy(*keys).orderBy("start")
    return sessions.withColumn("end", F.least("end", F.lead("start").over(w)))


def effective(sessions: DataFrame) -> DataFrame:
    """effective_start and effective_end: the override where there is one."""
    return sessions.withColumn("effective_start", F.coalesce("start_override", "scheduled_start_time")).withColumn(
        "effective_end", F.coalesce("end_override", "scheduled_end_time")
    )


def state(start: Column, end: Column, now: Column) -> Column:
    return F.when(now < start, "UPCOMING").when(end.isNull() | (now < end), "ACTIVE").otherwise("ENDED")


def cancel_verdict(kind: Column, canceled_at: Column, start: Column, now: Column) -> Column:
    """First reason that forbids cancelling, else OK; the order is part of the rule."""
    return (
        F.when(kind != "SCHEDULED", "NOT_SCHEDULED_TYPE").when(canceled_at.isNotNull(), "ALREADY_CANCELED").when(start <= now, "NOT_UPCOMING").otherwise("OK")
    )


def uncancel_verdict(canceled_at: Column) -> Column:
    return F.when(canceled_at.isNull(), "SESSION_NOT_CANCELED").otherwise("OK")


def patch(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Changed fields of each key as a map of name to new value."""
    j = before.alias("b").join(after.alias("a"), key)
    cells = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("key"), F.col(f"a.{f}").cast("string").alias("value"))) for f in fields]
    return j.select(key, F.map_from_entries(F.array_compact(F.array(*cells))).alias("changed")).where(F.size("changed") > 0)


def same_days(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))
