"""Table writes as frames: inserts, upserts, conditional updates, deletes with cascades, rules, schema state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING."""
    return table.unionByName(rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: rows replace those of equal keys. One anti join, so a table of any size streams through it."""
    return table.join(rows.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def update(table: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def updated_rows(table: DataFrame, where: Column) -> DataFrame:
    """How many rows an update touches."""
    return table.agg(F.count_if(where).alias("changed"))


def delete_keys(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on), list(on), "left_anti")


def delete_cascade(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    return delete_keys(parent, gone, [key]), child.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")


def set_single(table: DataFrame, group: str, member: str, flag: str, group_value: Column, member_value: Column) -> DataFrame:
    """Clear a flag in a group and set it for one member, if the member is there."""
    inside = F.col(group) == group_value
    there = F.max((inside & (F.col(member) == member_value)).cast("int")).over(Window.partitionBy(group)) == 1
    return table.withColumn(flag, F.when(inside & there, F.col(member) == member_value).otherwise(F.col(flag)))


def schema_state(applied: DataFrame, registered: DataFrame) -> DataFrame:
    """Migrations by state: applied, pending or unknown."""
    j = applied.select("name", F.lit(1).alias("a")).join(registered.select("name", F.lit(1).alias("r")), "name", "full_outer")
    return j.select("name", F.when(F.col("a").isNull(), "pending").when(F.col("r").isNull(), "unknown").otherwise("applied").alias("state"))


def violations(table: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of those they break; a null outcome passes, as in a CHECK."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())))
    return table.withColumn("broken", broken).where(F.size("broken") > 0)


def pending_deletes(table: DataFrame, end: str, now: Column, keep: str) -> DataFrame:
    """Retention: rows that ended longer ago than ``keep``."""
    return table.where(F.col(end) < now - F.expr(f"INTERVAL {keep}"))


def inserted(rows: DataFrame, key: str, seed: str, generated: Mapping[str, Column] | None = None) -> DataFrame:
    """INSERT ... RETURNING: ``rows`` with a key derived from ``seed`` and their content, and generated columns.

    The key is a digest in the shape of a uuid, so a task that runs again gives the same one.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rows.columns)), 256)
    part = lambda a, n: F.substring(digest, a, n)
    uid = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))
    return rows.withColumns(dict(generated or {})).select(uid.alias(key), *rows.columns, *(generated or {}))


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table after an insert; columns that the new rows lack are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def audited(rows: DataFrame, params: Sequence[str]) -> DataFrame:
    """Audit rows whose parameters are one JSON text."""
    return rows.withColumn("params_summary", F.to_json(F.struct(*params))).drop(*params)


def add_member(members: DataFrame, group: str, member: str, flag: str, group_value: Column, member_value: Column, as_flagged: bool) -> DataFrame:
    """Insert one membership; one that carries the flag clears it in its group first. A member that is there already stays as it is."""
    new = members.sparkSession.range(1).select(group_value.alias(group), member_value.alias(member), F.lit(as_flagged).alias(flag))
    there = members.where(F.col(member) == member_value).limit(1).select(F.lit(True).alias("_there"))
    new = new.join(F.broadcast(there), how="left").where("_there is null").drop("_there")  # one row
    cleared = members
    if as_flagged:
        cleared = members.join(F.broadcast(new.select(F.col(group).alias("_g"))), F.col(group) == F.col("_g"), "left")
        cleared = cleared.withColumn(flag, F.when(F.col("_g").isNotNull(), F.lit(False)).otherwise(F.col(flag))).select(*members.columns)
    return cleared.unionByName(new.select(*members.columns))


def bumped(table: DataFrame, keys: DataFrame, key: str, version: str, touched: str, now: Column) -> DataFrame:
    """Version plus one and a new time stamp for the rows whose key is among ``keys``: what ends every write to a room."""
    hit = table.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    on = F.col("_hit").isNotNull()
    return hit.withColumn(version, F.col(version) + on.cast("int")).withColumn(touched, F.when(on, now).otherwise(F.col(touched))).select(*table.columns)
