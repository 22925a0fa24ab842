"""Point lookups, row mappings and the filters that go with them.

A lookup is a pushed-down equality and a limit of one row. Where a database would lock the row, the
writer owns it instead: one task writes a key (``tables.upsert``), so a lookup needs no lock.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(df: DataFrame, key: str, value: object, *columns: str | Column) -> DataFrame:
    """The row whose ``key`` is ``value``, if there is one."""
    hit = df.where(F.col(key) == F.lit(value)).limit(1)
    return hit.select(*columns) if columns else hit


def locked(df: DataFrame, key: str, value: object, *columns: str) -> DataFrame:
    """What a writer of this key reads first: the row's key and the given columns. The lock is that one task writes a key."""
    return point(df, key, value, key, *columns)


def enum_array(text: str | Column) -> Column:
    """``{A,B}`` as an array; ``{}`` is empty, null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    inner = F.btrim(text, F.lit("{}"))
    return F.when(text.isNull(), None).when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def renamed(df: DataFrame, fields: Mapping[str, str], arrays: Iterable[str] = ()) -> DataFrame:
    """Rows under the names of the interface: ``fields`` maps column to name; ``arrays`` hold enum texts."""
    arrays = set(arrays)
    return df.select(*((enum_array(c) if c in arrays else F.col(c)).alias(name) for c, name in fields.items()))


#: Columns of a row and their names in the interface.
SCHEDULE = {
    "uid": "uid", "room_uid": "roomUid", "name": "name", "active_start": "activeStart", "active_end": "activeEnd", "anchor_start": "anchorStart",
    "local_start_time": "localStartTime", "local_end_time": "localEndTime", "frequency": "frequency", "days_of_week": "daysOfWeek",
}
WINDOW = {
    "uid": "uid", "room_uid": "roomUid", "local_start_time": "localStartTime", "local_end_time": "localEndTime", "days_of_week": "daysOfWeek",
    "active_start": "activeStart", "active_end": "activeEnd",
}
DEVICE = {"uid": "uid", "name": "name", "active": "active", "last_seen_at": "lastSeenAt", "room_uid": "roomUid", "is_source": "isSource", "created_at": "createdAt"}
ROOM = {"uid": "uid", "name": "name", "timezone": "timezone", "auto_session_enabled": "autoSessionEnabled", "created_at": "createdAt"}


def schedules(df: DataFrame) -> DataFrame:
    return renamed(df, SCHEDULE, ["days_of_week"])


def windows(df: DataFrame) -> DataFrame:
    return renamed(df, WINDOW, ["days_of_week"])


def devices(df: DataFrame) -> DataFrame:
    """Devices joined with their membership; without one the room is null and the flag false."""
    return renamed(df.withColumn("is_source", F.coalesce("is_source", F.lit(False))), DEVICE)


def rooms(df: DataFrame) -> DataFrame:
    return renamed(df, ROOM)


def session_for_auth(sessions: DataFrame, uid: object) -> DataFrame:
    """uid, room, effective start and end (overrides first) and the cancel time of one session."""
    return point(
        sessions, "uid", uid, "uid", "room_uid", F.coalesce("start_override", "scheduled_start").alias("effective_start"),
        F.coalesce("end_override", "scheduled_end").alias("effective_end"), "canceled_at", "version",
    )


def source_of_room(members: DataFrame, room: object) -> DataFrame:
    """The source device of a room."""
    return members.where((F.col("room_uid") == F.lit(room)) & F.col("is_source")).limit(1).select("device_uid")


def is_source_for(members: DataFrame, device: object, room: object) -> DataFrame:
    """One row: whether the device is the source of the room."""
    here = (F.col("device_uid") == F.lit(device)) & (F.col("room_uid") == F.lit(room)) & F.col("is_source")
    return members.where(here).agg((F.count("*") > 0).alias("is_source"))


def matches_subset(labels: str | Column, pattern: Mapping[str, str]) -> Column:
    """Whether a label map holds every pair of the pattern; an empty pattern matches all."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    out = F.lit(True)
    for key, value in pattern.items():
        out = out & labels[F.lit(key)].eqNullSafe(F.lit(value))
    return out


def summarized_checks(checks: str | Column) -> Column:
    """``name: what`` of every check that says something, joined by ``; ``; null where none does."""
    entries = F.filter(F.map_entries(checks), lambda e: e["value"].isNotNull())
    return F.when(F.size(entries) > 0, F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "; "))


def unassigned(devices_: DataFrame, members: DataFrame) -> DataFrame:
    """Devices without a room: an anti join."""
    return devices_.join(members.select(F.col("device_uid").alias("uid")), "uid", "left_anti")


def open_schedules(schedules_: DataFrame, room: object, now: Column) -> DataFrame:
    """Schedules of a room that have not ended; a null end never does."""
    return schedules_.where((F.col("room_uid") == F.lit(room)) & (F.col("active_end").isNull() | (F.col("active_end") > now)))


def sessions_in_range(sessions: DataFrame, kinds: list[str], start: Column, end: Column) -> DataFrame:
    """Sessions of these kinds, not cancelled, that overlap [start, end); a null end is open."""
    return sessions.where(
        F.col("type").isin(kinds) & F.col("canceled_at").isNull() & (F.col("effective_start") < end)
        & (F.col("effective_end").isNull() | (F.col("effective_end") > start))
    )


def next_start(sessions: DataFrame, keys: list[str], kinds: list[str], after: Column) -> DataFrame:
    """Earliest start after an instant, of each key; cancelled sessions do not count."""
    good = sessions.where(F.col("type").isin(kinds) & F.col("canceled_at").isNull() & (F.col("effective_start") > after))
    return good.groupBy(*keys).agg(F.min("effective_start").alias("next_start"))


def active_codes(codes: DataFrame, session: str, now: Column) -> DataFrame:
    """Join codes of one session that have not ended, present and future ones, earliest first."""
    return codes.where((F.col("session_uid") == F.lit(session)) & (F.col("valid_end") > now)).orderBy("valid_start", "join_code")


def upcoming(sessions: DataFrame, kinds: list[str], now: Column) -> DataFrame:
    """Sessions of these kinds that start after an instant, earliest first in each room."""
    return sessions.where(F.col("type").isin(kinds) & (F.col("effective_start") > now)).orderBy("room_uid", "effective_start", "uid")
