"""Small values: clock probes, thresholds, colours, halves of a text, a meter's reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.transcript import CLOSERS, MARKS

#: Duty ratios above which a provider is busy, on a CPU and on anything else or unknown.
CPU_DUTY, DUTY = 0.7, 0.45


def clock_sample(t0: Column, t1: Column, t3: Column) -> Column:
    """struct(rtt, offset) of a probe sent at t0, answered at t1 (remote clock), received at t3; no offset where the trip is negative."""
    rtt = t3 - t0
    return F.struct(rtt.alias("rtt"), F.when(rtt >= 0, t1 - (t0 + t3) / 2).alias("offset"))


def to_remote(local: Column, offset: Column) -> Column:
    """A local time on the remote clock; null without an offset."""
    return local + offset


def probe_rows(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Probes made of one number, around seven times it on the local clock and four times it on the remote one; some trips are negative."""
    rtt = value * 10 - 200
    t0 = value * 7 - rtt / 2
    s = clock_sample(t0, (value * 3 + value * 5) / 2, t0 + rtt)
    out = df.select(key, s.alias("s")).select(key, F.col("s.rtt").alias("rtt"), F.col("s.offset").alias("offset"))
    return out.withColumn("remote", to_remote(F.lit(1000.0), F.col("offset")))


def unknown_threshold(device: Column) -> Column:
    """The duty ratio of a provider's device; one that names none counts as no CPU."""
    return F.when(device == "cpu", CPU_DUTY).otherwise(DUTY)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of an sRGB colour of 0 to 255."""
    def linear(x: Column) -> Column:
        c = x / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two luminances, 1 to 21."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def bisected(text: Column) -> Column:
    """Two trimmed halves, cut where a chunk of half the letters would end (``transcript.cut_point``); null where one of them would be empty."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    half = F.ceil(F.length(t) / 2).cast("int")
    head = F.substring(t, F.lit(1), half)
    one_of = lambda letters: "[" + "".join("\\" + c for c in letters) + "]"
    ends = [r"(?s)^(.+\n\n)", rf"(?s)^(.*{one_of(MARKS)}{one_of(CLOSERS)}*\s)", r"(?s)^(.+\s)"]
    found = [F.length(F.regexp_extract(head, e, 1)) for e in ends]
    cut = F.coalesce(*(F.when(c > 0, c) for c in found), half)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    first, second = trim(F.substring(t, F.lit(1), cut)), trim(F.substring(t, cut + 1, F.length(t)))
    return F.when((F.length(t) >= 2) & (first != "") & (second != ""), F.array(first, second))


def meter(samples: Column, silence: float) -> Column:
    """struct(rms, peak, silent) of a window of samples; null without any."""
    x = F.transform(samples, lambda v: v.cast("double"))
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x))
    peak = F.array_max(F.transform(x, lambda v: F.abs(v)))
    return F.when(F.size(x) > 0, F.struct(rms.alias("rms"), peak.alias("peak"), (rms <= silence).alias("silent")))
