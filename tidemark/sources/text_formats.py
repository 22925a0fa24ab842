"""Line formats: speaker turns (RTTM), scored regions (UEM), log times, period lists, metric exposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def rttm_turns(lines: DataFrame, line: str = "value") -> DataFrame:
    """file, start, end, label of SPEAKER lines; other lines are left out, and what a line lacks is null."""
    p = lambda k: F.get(F.split(F.trim(line), r"\s+"), F.lit(k))
    start, dur = p(3).try_cast("double"), p(4).try_cast("double")
    return lines.where(F.col(line).startswith("SPEAKER")).select(p(1).alias("file"), start.alias("start"), (start + dur).alias("end"), p(7).alias("label"))


def rttm_lines(turns: DataFrame) -> DataFrame:
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "file", "start", F.col("end") - F.col("start"), "label")
    return turns.select(line.alias("value"))


def uem_regions(lines: DataFrame, line: str = "value") -> DataFrame:
    """file, start, end of scored regions; blank lines are left out, and what a line lacks is null."""
    p = lambda k: F.get(F.split(F.trim(line), r"\s+"), F.lit(k))
    return lines.where(F.trim(line) != "").select(p(0).alias("file"), p(2).try_cast("double").alias("start"), p(3).try_cast("double").alias("end"))


def uem_lines(regions: DataFrame) -> DataFrame:
    return regions.select(F.format_string("%s 1 %.3f %.3f", "file", "start", "end").alias("value"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    return rttm_turns(spark.read.text(path))


def write_rttm(turns: DataFrame, path: str) -> None:
    rttm_lines(turns).write.text(path)


def read_uem(spark: SparkSession, path: str) -> DataFrame:
    return uem_regions(spark.read.text(path))


def write_uem(regions: DataFrame, path: str) -> None:
    uem_lines(regions).write.text(path)


def logged_times(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Every number that a pattern's first group finds in a log."""
    found = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
    return spark.read.text(path).select(F.explode(found).cast("double").alias("seconds"))


def job_periods(spec: Column) -> Column:
    """key=ms,key=ms as a map of positive numbers; entries that are not so are left out."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.split(F.trim(x), "=")), lambda p: F.size(p) == 2)
    pairs = F.transform(parts, lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).try_cast("double").alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] > 0)))


def fragment(url: Column) -> Column:
    """Options of a URL's fragment as a map."""
    ref = F.try_parse_url(url, F.lit("REF"))
    return F.when(ref.isNotNull(), F.str_to_map(ref, F.lit("&"), F.lit("=")))


def merged_maps(base: Column, over: Column) -> Column:
    """``over`` wins where both have a key."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)


def series_key(labels: Column) -> Column:
    """a=1,b=2 with sorted names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def parsed_series_key(key: Column) -> Column:
    return F.when(key == "", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.str_to_map(key, F.lit(","), F.lit("=")))


def escaped(value: Column) -> Column:
    """Backslash, quote and line break of a label value."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def exposition(df: DataFrame, name: str, kind: str, labels: Sequence[str], value: str, help_text: str) -> DataFrame:
    """Lines of one metric: help, type and a line per series, in order."""
    pairs = [F.concat(F.lit(f'{c}="'), escaped(F.col(c).cast("string")), F.lit('"')) for c in labels]
    inside = F.concat_ws(",", *pairs) if pairs else F.lit("")
    line = F.concat(F.lit(name), F.when(inside != "", F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(""), F.lit(" "), F.col(value).cast("string"))
    head = df.sparkSession.createDataFrame([(0, f"# HELP {name} {help_text}"), (1, f"# TYPE {name} {kind}")], "place int, value string")
    return head.unionByName(df.select(F.lit(2).alias("place"), line.alias("value"))).orderBy("place", "value")


def snapshot_json(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON object per row."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))


def deep_merged(base: Column, over: Column, base_type: StructType, over_type: StructType) -> Column:
    """Struct of the fields of both: nested structs are merged, any other value of ``over`` wins where it is not null."""
    mine, theirs = {f.name: f.dataType for f in base_type}, {f.name: f.dataType for f in over_type}
    fields = []
    for name in [*mine, *(n for n in theirs if n not in mine)]:
        if name not in theirs:
            value = base[name]
        elif name not in mine:
            value = over[name]
        elif isinstance(mine[name], StructType) and isinstance(theirs[name], StructType):
            value = deep_merged(base[name], over[name], mine[name], theirs[name])
        else:
            value = F.coalesce(over[name], base[name])
        fields.append(value.alias(name))
    return F.struct(*fields)


def config_fragment(url: Column) -> Column:
    """The JSON text that a URL's fragment ``config=`` carries in base 64; null without one."""
    ref = F.try_parse_url(url, F.lit("REF"))
    return F.when(ref.startswith("config="), F.decode(F.unbase64(F.substring(ref, 8, 1 << 20)), "utf-8"))


def built_snapshot(counters: DataFrame, probes: DataFrame, alerts: DataFrame, canary: DataFrame, now: Column) -> DataFrame:
    """One row ``json``: counters, probes and alerts as sorted arrays, the last canary run or null, and the time."""
    rows = [df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)) for name, df in (("counters", counters), ("probes", probes), ("alerts", alerts))]
    last = canary.agg(F.max_by(F.struct(*canary.columns), "at").alias("canary"))
    out = last
    for r in rows:
        out = out.crossJoin(r)  # one row each
    return out.select(F.to_json(F.struct(now.alias("at"), "counters", "probes", "alerts", "canary"), {"ignoreNullFields": "false"}).alias("json"))
