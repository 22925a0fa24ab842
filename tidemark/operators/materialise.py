"""The materialisation of all stale rooms in one batch: occurrences, automatic sessions, versions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import intervals, schedule, tables

#: Kinds of session that block automatic ones.
PLANNED = ("SCHEDULED", "ON_DEMAND")


#: A time of day, and an offset that stands for a zone.
CLOCK = r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"
OFFSET = r"^(Z|(GMT|UTC|UT)?[+-](0?\d|1[0-7])(:[0-5]\d)?|(GMT|UTC|UT)?[+-]18(:00)?)$"
FREQUENCIES = ("ONCE", "WEEKLY", "BIWEEKLY")


class Written(NamedTuple):
    """New sessions, uids of automatic ones that go, the rooms with their versions, and (room_uid, reason) of those that were set aside."""

    inserted: DataFrame
    deleted: DataFrame
    rooms: DataFrame
    failed: DataFrame


def add_days(at: Column, days: int) -> Column:
    """Days of 24 hours, whatever clocks do."""
    return at + F.make_dt_interval(hours=F.lit(24 * days))


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def admitted(start: Column, end: Column, begin: Column, until: Column) -> Column:
    """An occurrence belongs to [begin, until) if it ends after its begin and starts before its end."""
    return (end > begin) & (start < until)


def by_start(slots: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """``slots`` with place, their number in the order of start, end and ``tie`` among those of their keys."""
    return slots.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("start", F.asc_nulls_last("end"), tie)))


def stale(rooms: DataFrame, cutoff: Column) -> DataFrame:
    """Rooms never materialised, or last at or before ``cutoff``."""
    return rooms.where(F.col("last_materialized_at").isNull() | (F.col("last_materialized_at") <= cutoff))


def zones(spark: SparkSession) -> DataFrame:
    """(timezone): the names of zones that the session's clock functions know."""
    return spark.createDataFrame([(z,) for z in sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())], "timezone string")


def set_aside(rooms: DataFrame, schedules: DataFrame, windows: DataFrame) -> DataFrame:
    """(room_uid, reason) of rooms that cannot be materialised: one row a room, the first reason by name.

    A room fails by its own zone, or by any of its schedules and windows. What is found here is all that the expansion's
    functions would end the job for, and what they would silently leave out.
    """
    known = zones(rooms.sparkSession).withColumn("_known", F.lit(True))
    own = rooms.join(F.broadcast(known), "timezone", "left")  # some hundred names
    fine = F.col("_known") | F.coalesce(F.col("timezone").rlike(OFFSET), F.lit(False))
    found = own.where(~F.coalesce(fine, F.lit(False))).select(F.col("uid").alias("room_uid"), F.concat(F.lit("unknown time zone "), F.coalesce("timezone", F.lit("(null)"))).alias("reason"))
    for kind, df in (("schedule", schedules), ("window", windows)):
        clock = lambda c: F.coalesce(F.col(c).rlike(CLOCK), F.lit(False))
        wrong = (
            F.when(~clock("local_start_time") | ~clock("local_end_time"), "no time of day")
            .when(~F.coalesce(F.col("frequency").isin(*FREQUENCIES), F.lit(False)), "unknown frequency")
            .when(F.col("anchor_start").isNull() | F.col("active_start").isNull(), "no begin")
            .when((F.col("frequency") != "ONCE") & ~F.coalesce(F.arrays_overlap("days_of_week", F.array(*map(F.lit, schedule.DAYS))), F.lit(False)), "no days")
            .when(F.col("active_end") < F.col("active_start"), "ends before it begins")
        )
        bad = df.withColumn("_wrong", wrong).where("_wrong is not null")
        found = found.unionByName(bad.select("room_uid", F.concat(F.lit(f"{kind} "), F.col("uid").cast("string"), F.lit(": "), F.col("_wrong")).alias("reason")))
    return found.groupBy("room_uid").agg(F.min("reason").alias("reason"))


def materialised(
    rooms: DataFrame, schedules: DataFrame, windows: DataFrame, sessions: DataFrame, now: Column, cutoff: Column, days: int = schedule.HORIZON_DAYS
) -> Written:
    """What the stale rooms need to hold sessions for ``days`` more days.

    A schedule goes on after the end of its last session; automatic sessions fill what planned ones
    leave of their windows, and those that no longer fit and have not begun go. Every stale room gets
    a new version. A room is a key of joins, so all rooms are one job; rooms that would end it are set
    aside before, with a reason, keep their version, and so are stale again the next time.

    rooms: uid, timezone, auto_session_enabled, version, last_materialized_at. schedules and windows: as
    ``schedule.occurrences`` takes them, and room_uid. sessions: uid, room_uid, schedule_uid, type,
    effective_start, effective_end, canceled_at.
    """
    due = stale(rooms, cutoff)
    failed = set_aside(due, schedules.join(due.select(F.col("uid").alias("room_uid")), "room_uid", "left_semi"), windows.join(due.select(F.col("uid").alias("room_uid")), "room_uid", "left_semi"))
    due = due.join(failed.select(F.col("room_uid").alias("uid")), "uid", "left_anti")
    until = add_days(now, days)
    here = due.select(F.col("uid").alias("room_uid"), "timezone", "auto_session_enabled")
    last = sessions.where("type = 'SCHEDULED'").groupBy(F.col("schedule_uid").alias("uid")).agg(F.max("effective_end").alias("_last"))
    open_ = schedules.join(here, "room_uid").where(F.col("active_end").isNull() | (F.col("active_end") > now)).join(last, "uid", "left")
    open_ = open_.withColumn("_from", later(F.coalesce("_last", now), F.col("active_start"))).where(F.col("_from") < until)
    found = schedule.occurrences(open_, F.col("_from"), until)
    found = found.join(open_.select("uid", "room_uid", "_from"), "uid").where(admitted(F.col("start_utc"), F.col("end_utc"), F.col("_from"), until))
    planned = found.select(F.col("uid").alias("schedule_uid"), "room_uid", F.lit("SCHEDULED").alias("type"), F.col("start_utc").alias("effective_start"), F.col("end_utc").alias("effective_end"))

    sec = lambda c: F.unix_timestamp(c).cast("double")
    auto = windows.join(here.where("auto_session_enabled"), "room_uid").where(F.col("active_end").isNull() | (F.col("active_end") > now))
    slots = schedule.occurrences(auto, now, until).join(auto.select("uid", "room_uid"), "uid")
    slots = slots.select("room_uid", F.concat_ws("@", "uid", "start_utc").alias("uid"), sec(F.greatest("start_utc", now)).alias("start"), sec("end_utc").alias("end"))
    current = sessions.where(F.col("canceled_at").isNull()).join(here.select("room_uid"), "room_uid")
    blockers = current.where(F.col("type").isin(*PLANNED)).select("room_uid", "effective_start", "effective_end").unionByName(planned.select("room_uid", "effective_start", "effective_end"))
    blockers = blockers.select("room_uid", sec("effective_start").alias("start"), F.coalesce(sec("effective_end"), F.lit(4e9)).alias("end"))
    free = intervals.free_slots(slots, blockers, ["room_uid"], float(schedule.LEAST_SECONDS)).select("room_uid", F.col("slot_start").alias("start"), F.col("slot_end").alias("end"))
    old = current.where("type = 'AUTO'").select("uid", "room_uid", sec("effective_start").alias("start"), sec("effective_end").alias("end"))
    # a running automatic session keeps its start, so its slot is met by its end
    running = old.where((F.col("start") <= sec(now)) & (F.col("end") > sec(now))).select("room_uid", F.col("start").alias("_began"), "end")
    free = free.join(running, ["room_uid", "end"], "left").withColumn("start", F.coalesce("_began", "start")).drop("_began")
    action = schedule.reconcile(free, old.drop("uid"), ["room_uid"], sec(now))
    at = lambda c: F.timestamp_seconds(c)
    automatic = action.where("action = 'insert'").select(
        F.lit(None).cast("string").alias("schedule_uid"), "room_uid", F.lit("AUTO").alias("type"), at("start").alias("effective_start"), at("end").alias("effective_end")
    )
    rows = planned.withColumn("schedule_uid", F.col("schedule_uid").cast("string")).unionByName(automatic)
    gone = action.where("action = 'delete'").join(old, ["room_uid", "start", "end"]).select("uid", "room_uid")
    return Written(tables.inserted(rows, "uid", "session"), gone, tables.bumped(rooms, due, "uid", "version", "last_materialized_at", now), failed)
