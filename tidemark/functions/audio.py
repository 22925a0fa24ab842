"""Level statistics of PCM sample arrays (doubles in -1..1, or 16-bit integers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = -120.0
RAIL = 32767


def dbfs(v: Column) -> Column:
    """20 log10, not below the floor; the floor for zero and below."""
    return F.when(v <= 0, FLOOR).otherwise(F.greatest(F.lit(FLOOR), 20 * F.log10(v)))


def _sum(samples: Column, f) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, x: s + f(x.cast("double")))


def rms(samples: Column) -> Column:
    return F.when(F.size(samples) > 0, F.sqrt(_sum(samples, lambda x: x * x) / F.size(samples))).otherwise(0.0)


def rms_dbfs(pcm: Column) -> Column:
    """dBFS of 16-bit samples; minus infinity for none or silence."""
    r = rms(pcm) / 32768
    return F.when(r > 0, 20 * F.log10(r)).otherwise(float("-inf"))


def dc_offset(samples: Column) -> Column:
    return F.when(F.size(samples) > 0, _sum(samples, lambda x: x) / F.size(samples)).otherwise(0.0)


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def saturated(v: Column) -> Column:
    return F.greatest(F.lit(-RAIL - 1), F.least(F.lit(RAIL), F.rint(v).cast("int")))


def clipped_fraction(pcm: Column) -> Column:
    """Share of samples at the rails."""
    hit = F.size(F.filter(pcm, lambda x: F.abs(x) >= RAIL))
    return F.when(F.size(pcm) > 0, hit / F.size(pcm)).otherwise(0.0)


def clipped_runs(pcm: Column, least: int = 2) -> Column:
    """Share of samples in runs of ``least`` or more at one rail."""
    zero = F.struct(F.lit(0).alias("sign"), F.lit(0).alias("run"), F.lit(0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        sign = F.when(x >= RAIL, 1).when(x <= -RAIL, -1).otherwise(0)
        run = F.when(sign == 0, 0).when(sign == s["sign"], s["run"] + 1).otherwise(1)
        add = F.when(run == least, least).when(run > least, 1).otherwise(0)
        return F.struct(sign.alias("sign"), run.alias("run"), (s["sum"] + add).alias("sum"))

    return F.when(F.size(pcm) > 0, F.aggregate(pcm, zero, step)["sum"] / F.size(pcm)).otherwise(0.0)


def gained(pcm: Column, db: float) -> Column:
    return F.transform(pcm, lambda x: saturated(x * float(10 ** (db / 20))))


def shifted(pcm: Column, offset: int) -> Column:
    return F.transform(pcm, lambda x: saturated((x + offset).cast("double")))


def hard_clipped(pcm: Column, share: float) -> Column:
    """Scaled so that the loudest ``share`` of samples reaches the rail."""
    loud = F.sort_array(F.transform(pcm, lambda x: F.abs(x)), asc=False)
    at = F.element_at(loud, F.greatest(F.lit(1), F.floor(F.size(pcm) * share).cast("int")))
    return F.when(at > 0, F.transform(pcm, lambda x: saturated(x * (RAIL / at)))).otherwise(pcm)


def silent(samples: Column, peak_limit: float, rms_limit: float) -> Column:
    return (F.size(samples) == 0) | (peak(samples) <= peak_limit) & (rms(samples) <= rms_limit)


def vad_stats(ranges: Column, total: Column) -> Column:
    """struct(active_ratio, segments, mean_seconds, speech_to_pause) of speech ranges; the last is null without a pause."""
    speech = F.aggregate(ranges, F.lit(0.0), lambda s, r: s + (r["end"] - r["start"]))
    ratio = F.try_divide(speech, total)
    return F.struct(
        ratio.alias("active_ratio"), F.size(ranges).alias("segments"), F.try_divide(speech, F.size(ranges)).alias("mean_seconds"),
        F.when(ratio < 1, speech / (total - speech)).alias("speech_to_pause"),
    )


def _block_levels(samples: Column, block: int) -> Column:
    """dBFS of consecutive blocks; a last shorter one is left out."""
    n = F.floor(F.size(samples) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: dbfs(rms(F.slice(samples, k * block + 1, F.lit(block)))))
    return F.when(n > 0, blocks)


def noise_floor(samples: Column, block: int = 160) -> Column:
    """Tenth percentile of the blocks' levels, interpolated; null without a whole block."""
    s = F.sort_array(_block_levels(samples, block))
    at = (F.size(s) - 1) * 0.1
    lo = F.floor(at).cast("int")
    a, b = F.element_at(s, lo + 1), F.element_at(s, F.least(lo + 2, F.size(s)))
    return a + (b - a) * (at - lo)


def snr(samples: Column, block: int = 160) -> Column:
    """Level of the whole over the noise floor, in dB."""
    return dbfs(rms(samples)) - noise_floor(samples, block)
