"""Channels and landing tables: validated subscriptions, status polls, probes, heartbeats, JSON reports.

Nothing here speaks HTTP or pub/sub: a collector lands messages as files (or Kafka topics), and these
frames give them a schema, put what does not fit aside, and keep the newest state by key.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.fleet import closed_set, parsed
from tidemark.sources.audio_frames import decode_samples

#: Why a poll can fail.
POLL_REASONS = ("unreachable", "unauthorized", "not-found", "http-error", "malformed")
POLLS = "poll_ts timestamp, service string, status int, body string, error string"
PROBES = "probe_ts timestamp, service string, kind string, ok boolean, millis double"


def subscribed(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(messages, quarantine) of a channel that lands as text files, a JSON message a line: a stream of each.

    Messages have channel (the file's folder) and a typed ``body``; the quarantine keeps raw lines that do not fit.
    """
    raw = spark.readStream.format("text").load(folder).withColumn("channel", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return parsed(raw, "value", schema)


def published(stream: DataFrame, sinks: dict[str, Column], folder: str, checkpoint: str):
    """Fan one stream out to topics: each of ``sinks`` is a folder that gets the rows that meet its condition."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for name, on in sinks.items():
            batch.where(on).write.mode("overwrite").json(f"{folder}/{name}/batch={epoch}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def status_polls(spark: SparkSession, folder: str, body: str) -> DataFrame:
    """Landed polls with their outcome: ok and a typed body, or one reason of a closed set."""
    raw = spark.read.schema(POLLS).json(folder)
    return polled(raw, body)


def polled(raw: DataFrame, body: str) -> DataFrame:
    """``raw`` (POLLS) with ok, reason, body and restarted: whether the process differs from the one before."""
    from pyspark.sql import Window

    typed = F.from_json("body", body)
    known = typed["processUid"].isNotNull()
    reason = (
        F.when(F.col("error").isNotNull(), "unreachable").when(F.col("status").isin(401, 403), "unauthorized").when(F.col("status") == 404, "not-found")
        .when(~F.col("status").between(200, 299), "http-error").when(~known, "malformed")
    )
    out = raw.withColumn("reason", closed_set(reason, list(POLL_REASONS))).withColumn("reason", F.when(reason.isNotNull(), F.col("reason")))
    out = out.withColumn("ok", F.col("reason").isNull()).withColumn("body", F.when(F.col("ok"), typed))
    seen = F.last("body.processUid", ignorenulls=True).over(Window.partitionBy("service").orderBy("poll_ts").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("restarted", F.coalesce(F.col("ok") & (seen != F.col("body.processUid")), F.lit(False)))


def probe_results(raw: DataFrame) -> DataFrame:
    """Newest outcome of each service and kind of probe, and since when it has been so."""
    from pyspark.sql import Window

    w = Window.partitionBy("service", "kind").orderBy("probe_ts")
    change = F.coalesce(F.lag("ok").over(w) != F.col("ok"), F.lit(True))
    since = raw.withColumn("_since", F.last(F.when(change, F.col("probe_ts")), ignorenulls=True).over(w))
    return since.groupBy("service", "kind").agg(F.max_by(F.struct("ok", F.col("_since").alias("since"), "probe_ts", "millis"), "probe_ts").alias("r")).select("service", "kind", "r.*")


def with_expiry(snapshots: DataFrame, at: str, ttl: str) -> DataFrame:
    """Heartbeats as they are stored: a snapshot lives for ``ttl`` after its time."""
    return snapshots.withColumn("expires_at", F.col(at) + F.expr(f"INTERVAL {ttl}"))


def heartbeats(stream: DataFrame, path: str, keys: list[str], at: str, ttl: str, checkpoint: str):
    """Keep the newest snapshot of each member at ``path``; readers drop those past ``expires_at``, and they go when runs are merged."""
    from tidemark.streaming.tables import upserted

    return upserted(with_expiry(stream, at, ttl), path, keys, at, checkpoint, expires="expires_at")


def fleet_snapshot(nodes: DataFrame, sessions: DataFrame, hosts: DataFrame, audio: DataFrame, now: Column) -> DataFrame:
    """One row of four arrays: what is alive of each kind, by id. Each frame has id, expires_at and what else it reports."""
    arrays = []
    for name, df in (("nodes", nodes), ("sessions", sessions), ("hosts", hosts), ("sessionAudio", audio)):
        rows = df.where(F.col("expires_at") > now).drop("expires_at")
        arrays.append(rows.agg(F.sort_array(F.collect_list(F.struct("id", *(c for c in rows.columns if c != "id")))).alias(name)))
    out = arrays[0]
    for a in arrays[1:]:
        out = out.crossJoin(a)  # one row each
    return out


def write_json(df: DataFrame, path: str) -> None:
    """A report as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


#: Zero crossings of the resampling filter on either side, and how much of the band it passes when the rate falls.
CROSSINGS, PASSED = 24, 0.94


def resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Samples at another rate by a windowed sinc, a set of weights for each phase; what the new rate cannot carry is filtered out."""
    if rate == target or not len(x):
        return x
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    band = min(1.0, up / down * (PASSED if down > up else 1.0))
    half = int(np.ceil(CROSSINGS / band))
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + 1)])
    taps = sliding_window_view(padded, 2 * half + 1)
    out = np.empty(n)
    for phase in range(min(up, n)):
        at = np.arange(phase, n, up) * down
        t = np.arange(-half, half + 1) - at[0] % up / up
        weight = band * np.sinc(band * t) * np.i0(10.0 * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(10.0)
        out[phase::up] = taps[at // up] @ weight
    return out


def mono(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Samples by channel as one channel of floats at the target rate."""
    return resampled(samples.mean(1), rate, target).astype(np.float32)


def decoded_audio(df: DataFrame, content: str, target: int = 16_000) -> DataFrame:
    """``samples`` (floats, one channel at ``target`` Hz) of WAV files in a binary column; null where it is no such file or of no known format."""

    @F.pandas_udf("array<float>")
    def decode(data: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> np.ndarray | None:
            try:
                rate, samples = decode_samples(raw or b"")
            except ValueError:
                return None
            return mono(samples, rate, target)

        return data.map(one)

    return df.withColumn("samples", decode(content))
