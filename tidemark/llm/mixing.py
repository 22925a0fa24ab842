"""Mixing sources to target weights by hierarchical budgeting.

Target weights run down a domain - language - source tree. A node that cannot use its share, even
with every epoch it is allowed, passes the shortage to its siblings in proportion to their weights;
only what a whole subtree cannot use reaches the level above. Each leaf then takes whole epochs and
a prefix, in tokens, of one more epoch, in an order seeded per epoch. A leaf's decision is two
numbers (whole epochs, last hash of the prefix), so rows are chosen without moving any text.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import restored, rows_table, scratch, shielded, written

#: Leaves up to which their decisions are sent to all tasks; those of more meet the rows in a shuffle.
BROADCAST_LEAVES = 100_000
#: Bits of the seeded order by which each step narrows the place where a leaf's prefix ends, and steps.
ORDER_BITS, STEPS = 8, 4
#: Stands for a null domain, language or source.
NONE = "(none)"
#: Production weights: by domain, then by language; sources of one language share alike.
WEIGHTS: dict[tuple, float] = {
    ("d0",): 0.4, ("d1",): 0.3, ("d2",): 0.2, ("d3",): 0.1,
    **{(f"d{k}", lang): w for k in range(4) for lang, w in (("en", 0.4), ("de", 0.2), ("fr", 0.2), ("es", 0.2))},
}

Path = tuple[str, ...]


def share_out(amount: float, weights: list[float], room: list[float]) -> list[float]:
    """Split ``amount`` by weight; what exceeds a part's room goes to the others by their weights."""
    got, open_ = [0.0] * len(room), [k for k in range(len(room)) if weights[k] > 0 and room[k] > 0]
    left = min(amount, float(sum(room[k] for k in open_)))
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total >= room[k] - got[k]]
        if not full:
            for k in open_:
                got[k] += left * weights[k] / total
            break
        for k in full:
            left -= room[k] - got[k]
            got[k] = float(room[k])
        open_ = [k for k in open_ if k not in full]
    return got


def leaf_budgets(tokens: dict[Path, int], total: float, weights: dict[Path, float], max_epochs: int) -> dict[Path, int]:
    """Tokens that each leaf gives. Nodes without a weight of their own count 1."""
    below: dict[Path, set[Path]] = defaultdict(set)
    room: dict[Path, int] = defaultdict(int)
    for path, n in tokens.items():
        for k in range(len(path) + 1):
            room[path[:k]] += n * max_epochs
            if k < len(path):
                below[path[:k]].add(path[: k + 1])
    out: dict[Path, int] = {}
    todo: list[tuple[Path, float]] = [((), float(total))]
    while todo:
        node, amount = todo.pop()
        kids = sorted(below[node])
        if not kids:
            out[node] = min(round(amount), room[node])
            continue
        got = share_out(amount, [weights.get(k, 1.0) for k in kids], [room[k] for k in kids])
        todo += zip(kids, got, strict=True)
    return out


def domain_of(source: str = "source") -> Column:
    """Four domains by the number that ends a source's name; sources without one have no domain."""
    number = F.regexp_extract(F.col(source), r"(\d{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.pmod(number.cast("int"), F.lit(4)).cast("string")))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _leafed(docs: DataFrame, domain: Column) -> DataFrame:
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return docs.withColumn(
        "_leaf", F.struct(text_of(domain).alias("domain"), text_of(F.col("lang")).alias("lang"), text_of(F.col("source")).alias("source"))
    )


def _order(seed: int, epoch: Column) -> Column:
    """Seeded place in an epoch, 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col("doc_id"), F.col("_h")), 1)


def decisions(
    docs: DataFrame, share: float, max_epochs: int, seed: int, weights: dict[Path, float] | None = None, domain: Column | None = None
) -> DataFrame:
    """A row per leaf: _leaf, tokens, budget, whole (epochs) and last (place where the prefix of the next ends; -1: none)."""
    spark = docs.sparkSession
    narrow = _leafed(docs, domain_of() if domain is None else domain)
    narrow = written(narrow.select("doc_id", "_leaf", F.xxhash64("text").alias("_h"), word_count().alias("n_tokens")), "tokens")
    rows = narrow.groupBy("_leaf").agg(F.sum("n_tokens").alias("n")).collect()  # a row a leaf
    tokens = {tuple(r["_leaf"]): r["n"] for r in rows}
    budgets = leaf_budgets(tokens, share * sum(tokens.values()), WEIGHTS if weights is None else weights, max_epochs)
    plan = (
        {"_leaf": dict(zip(("domain", "lang", "source"), p, strict=True)), "tokens": n, "budget": budgets[p], "whole": budgets[p] // n if n else 0, "part": budgets[p] % n if n else 0}
        for p, n in sorted(tokens.items())
    )
    leaves = rows_table(spark, plan, "_leaf struct<domain:string,lang:string,source:string>, tokens long, budget long, whole int, part long", "plan")
    small = F.broadcast if len(tokens) <= BROADCAST_LEAVES else lambda df: df
    placed = narrow.join(small(leaves.where("part > 0").select("_leaf", "whole", "part")), "_leaf")
    placed = placed.withColumn("_at", _order(seed, F.col("whole")))
    run = Window.partitionBy("_leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_from", F.lit(0).cast("long"))
    for k in range(1, STEPS + 1):  # sums of 2 ** ORDER_BITS ranges tell in which of them the prefix ends; only that one is looked into
        bucket = F.shiftright("_at", 63 - k * ORDER_BITS)
        sums = inside.groupBy("_leaf", "part", "_from", bucket.alias("_bucket")).agg(F.sum("n_tokens").alias("n"))
        sums = sums.withColumn("_before", F.col("_from") + F.coalesce(F.sum("n").over(run), F.lit(0)))
        edge = sums.where("_before < part").groupBy("_leaf").agg(F.max_by(F.struct("_bucket", "_before"), "_bucket").alias("e"))
        inside = placed.join(small(edge), "_leaf").where(bucket == F.col("e._bucket")).withColumn("_from", F.col("e._before")).drop("e")
    step = Window.partitionBy("_leaf").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("_from") + F.coalesce(F.sum("n_tokens").over(step), F.lit(0)))
    last = inside.where("start < part").groupBy("_leaf").agg(F.max("_at").alias("last"))
    return leaves.join(last, "_leaf", "left").select("_leaf", "tokens", "budget", "whole", F.coalesce("last", F.lit(-1)).alias("last"))


def mix(
    docs: DataFrame, share: float = 1.0, max_epochs: int = 4, seed: int = 7,
    weights: dict[Path, float] | None = None, domain: Column | None = None,
) -> DataFrame:
    """``docs`` as the mixture reads them: every column, and _leaf, _budget and _epoch; a row for each epoch that takes it.

    ``share`` of the corpus' words is the total. A leaf's prefix ends with the document that reaches
    its budget. Defined cases: null domain, lang or source form a leaf called ``(none)``; null and
    blank texts have no tokens and come with the prefix in which they stand; a leaf without tokens
    gives no rows; equal rows share their place; an empty table gives no rows; other columns stay.
    """
    outer, (docs, inner) = docs, shielded(docs)
    with scratch() as keep:
        plan = keep(written(decisions(docs, share, max_epochs, seed, weights, domain), "leaves"))
        if plan.count() <= BROADCAST_LEAVES:
            plan = F.broadcast(plan)
    rows = _leafed(docs, domain_of() if domain is None else domain).join(plan, "_leaf").withColumn("_h", F.xxhash64("text"))
    more = (_order(seed, F.col("whole")) <= F.col("last")).cast("int")
    rows = rows.withColumn("_times", F.col("whole") + more).where("_times > 0")
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return restored(rows.withColumnRenamed("budget", "_budget"), outer, inner, "_leaf", "_budget", "_epoch")
