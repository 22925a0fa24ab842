"""Speaker vectors: unit length, cosine, centroids, error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centroids(df: DataFrame, label: str, vector: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean vector of each label: sums per component, combined before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    cells = df.select(label, w.alias("w"), F.posexplode(vector).alias("k", "x"))
    sums = cells.groupBy(label, "k").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    parts = F.sort_array(F.collect_list(F.struct("k", "m")))
    return sums.groupBy(label).agg(F.transform(parts, lambda p: p["m"]).alias("centroid"))


#: Centroids that travel to all tasks as one array; more go in so many arrays, each of which meets all vectors.
LABELS = 4096


def nearest_label(df: DataFrame, centers: DataFrame, uid: str, vector: str, label: str, most: int = LABELS) -> DataFrame:
    """Label of the most similar centroid, the smaller one of equals.

    The centroids are one row a label. They are dealt to arrays of about ``most``; a vector is compared with each array by itself,
    and with more than one its best of each are compared.
    """
    arrays = max(1, -(-centers.count() // most))
    packed = centers.groupBy(F.pmod(F.xxhash64(label), F.lit(arrays)).alias("_part")).agg(F.collect_list(F.struct(label, "centroid")).alias("c"))
    best = F.array_max(F.transform("c", lambda c: F.struct(cosine(F.col(vector), c["centroid"]).alias("s"), (-c[label]).alias("o"))))
    if arrays == 1:
        j = df.join(F.broadcast(packed), how="cross")  # one row
        return j.select(uid, (-best["o"]).alias("nearest"), best["s"].alias("score"))
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(arrays - 1)))).join(packed, "_part").select(uid, best.alias("_b"))
    top = parts.groupBy(uid).agg(F.max("_b").alias("_b"))
    return top.select(uid, (-F.col("_b.o")).alias("nearest"), F.col("_b.s").alias("score"))


def error_rates(scores: DataFrame, threshold: Column) -> DataFrame:
    """false_split: same pairs below the threshold; false_merge: different ones at or above it."""
    return scores.agg(
        F.avg(F.when(F.col("same"), (F.col("score") < threshold).cast("double"))).alias("false_split"),
        F.avg(F.when(~F.col("same"), (F.col("score") >= threshold).cast("double"))).alias("false_merge"),
    )


def equal_error(scores: DataFrame, steps: int = 200) -> DataFrame:
    """The threshold on a grid of ``steps`` where the two errors differ least, and their mean: one pass over a histogram."""
    cell = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor((F.col("score") + 1) / 2 * steps))).cast("int")
    h = scores.groupBy(cell.alias("cell")).agg(F.count_if(F.col("same")).alias("s"), F.count_if(~F.col("same")).alias("d"))
    from pyspark.sql import Window

    w = Window.orderBy("cell")  # steps + 1 rows at most
    every = Window.partitionBy(F.lit(1))
    below = F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.sum("s").over(every)
    above = (F.sum("d").over(every) - F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("d").over(every)
    t = h.select((F.col("cell") / steps * 2 - 1).alias("threshold"), below.alias("split"), above.alias("merge"))
    return t.orderBy(F.abs(F.col("split") - F.col("merge")), "threshold").limit(1).select("threshold", ((F.col("split") + F.col("merge")) / 2).alias("equal_error"))
