"""Minimax contiguous sharding of atomic groups.

Groups (rows of equal text) are ordered by a digest of their text. The smallest capacity for
which a greedy left-to-right filling needs no more than ``shards`` shards is found by binary
search over prefix sums, and the cuts are where that filling closes a shard. The driver never
holds the groups: it sees key ranges, at most ``RANGES`` at a time, and refines only the ranges
in which a cut can still fall, so the result is exact for any number of groups.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns_of, drop_written, rows_table, written

#: Most key ranges that the driver looks at in one round.
RANGES = 1 << 16
#: Least sub-buckets over which the slots of a shard are numbered, and rows of one that more are made for.
SLOT_BUCKETS, SLOT_ROWS = 128, 1 << 16
#: Bits of the key; it is the first 63 bits of the text's digest.
KEY_BITS = 63

#: A key range: first key, width in bits, bytes, groups, largest group.
Range = tuple[int, int, int, int, int]


def _feasible(sizes: list[int], sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """First item of each shard after the first under greedy filling, or None if it needs too many."""
    at, cuts, n = 0, [], len(sizes)
    for _ in range(shards):
        base = sums[at - 1] if at else 0
        to = bisect_right(sums, base + capacity, lo=at)
        if to == n:
            return cuts
        if to == at:
            return None
        cuts.append(to)
        at = to
    return None


def smallest_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The least capacity that greedy filling can meet, and where it cuts."""
    sums = list(accumulate(sizes))
    total = sums[-1] if sums else 0
    lo, hi = max([-(-total // shards), *sizes]), total
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if _feasible(sizes, sums, mid, shards) is not None else (mid + 1, hi)
    return lo, _feasible(sizes, sums, lo, shards) or []


def _fluid_ends(ranges: list[Range], sums: list[int], capacity: int, shards: int, early: bool) -> list[int]:
    """Range that holds each shard's end under greedy filling when ranges of several groups can be cut.

    With ``early`` every end is the earliest it can be for this capacity, otherwise the latest.
    """
    ends, base, n = [], 0, len(ranges)
    for _ in range(shards):
        to = bisect_right(sums, base + capacity)
        if to >= n:
            break
        ends.append(to)
        start = sums[to - 1] if to else 0
        if ranges[to][3] == 1:
            base = start
        else:
            base = max(start, base + capacity - ranges[to][4]) if early else base + capacity
    return ends


def _fluid_feasible(ranges: list[Range], sums: list[int], capacity: int, shards: int) -> bool:
    base, n = 0, len(ranges)
    for _ in range(shards):
        to = bisect_right(sums, base + capacity)
        if to >= n:
            return True
        base = (sums[to - 1] if to else 0) if ranges[to][3] == 1 else base + capacity
    return False


def _ranges(groups: DataFrame, of: list[Range] | None, bits: int) -> list[Range]:
    """Split the key space, or each range of ``of``, by ``bits`` further bits and add up what each part holds."""
    if of is None:
        part = F.shiftright("key", KEY_BITS - bits)
        rows = groups.groupBy(part.alias("part")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("m"))
        return sorted((r["part"] << (KEY_BITS - bits), KEY_BITS - bits, r["b"], r["n"], r["m"]) for r in rows.collect())
    spark = groups.sparkSession
    wide = rows_table(spark, ({"head": r[0] >> r[1], "width": r[1]} for r in of), "head long, width int", "ranges")
    out: list[Range] = []
    for width in sorted({r[1] for r in of}):
        left = max(0, width - bits)
        some = F.broadcast(wide.where(F.col("width") == width).select("head"))  # RANGES rows at most
        rows = groups.withColumn("head", F.shiftright("key", width)).join(some, "head", "left_semi")
        rows = rows.groupBy(F.shiftright("key", left).alias("part"))
        rows = rows.agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("m"))
        out += [(r["part"] << left, left, r["b"], r["n"], r["m"]) for r in rows.collect()]
    drop_written(wide)
    return sorted(out)


def cuts_of(groups: DataFrame, shards: int, bits: int | None = None) -> tuple[int, list[int]]:
    """(capacity, first key of each shard after the first) of the minimax contiguous partition.

    ``groups`` has a long ``key`` below 2**63, unique, and long ``bytes``.
    """
    bits = bits or RANGES.bit_length() - 1
    ranges = _ranges(groups, None, bits)
    while True:
        sizes = [r[2] for r in ranges]
        if not sizes:
            return 0, []
        sums = list(accumulate(sizes))
        high, at = smallest_capacity(sizes, shards)
        low = max(-(-sums[-1] // shards), max(r[4] for r in ranges))
        lo, hi = low, high
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if _fluid_feasible(ranges, sums, mid, shards) else (mid + 1, hi)
        if lo == high:
            return high, [ranges[k][0] for k in at]
        first = _fluid_ends(ranges, sums, lo, shards, True)
        last = _fluid_ends(ranges, sums, high, shards, False)
        last += [len(ranges) - 1] * (len(first) - len(last))
        near = {k for a, b in zip(first, last, strict=False) for k in range(min(a, b), max(a, b) + 1)}
        near = sorted(k for k in near if ranges[k][3] > 1 and ranges[k][1] > 0)
        if not near:
            near = [k for k, r in enumerate(ranges) if r[3] > 1 and r[1] > 0][: RANGES // 2]
        if not near:
            return high, [ranges[k][0] for k in at]
        deeper = max(1, (RANGES // len(near)).bit_length() - 1)
        split = _ranges(groups, [ranges[k] for k in near], deeper)
        gone = set(near)
        ranges = sorted([r for k, r in enumerate(ranges) if k not in gone] + split)


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: groups of equal texts stay whole and the largest shard is as small as any
    contiguous placement of the groups in digest order allows. Slots number a shard's rows from
    zero without gaps. Defined cases: a null text has ``overhead`` bytes and the crc of no bytes, 0, and
    groups with other null texts, apart from empty ones; repeated rows and ids each get a slot; null ids
    are kept; a very long text is one group like any other; an empty table gives no rows; other columns
    are ignored, also where a name differs in case only. With fewer groups than shards the shards beyond
    stay empty.
    """
    docs = columns_of(docs, "doc_id", "text")
    text = F.col("text")
    digest = F.coalesce(F.md5(text), F.lit("0" * 32))
    key = F.shiftrightunsigned(F.conv(F.substring(digest, 1, 16), 16, -10).cast("long"), 1)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        key.alias("key"),
        F.xxhash64("doc_id", "text").alias("_hash"),
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = cuts_of(groups, shards)
    drop_written(groups)
    buckets = max(SLOT_BUCKETS, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int")).drop("_hash")
    shard = sum((F.when(F.col("key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = rows.withColumn("shard", shard)
    counts = placed.groupBy("shard", "_bucket").count()
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("key", "doc_id", "size")
    numbered = placed.withColumn("_at", F.row_number().over(inside) - 1).join(starts, ["shard", "_bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
