"""Approximate nearest neighbours through learned partitions.

On a bounded sample the neighbour graph is built exactly and cut into balanced partitions; a small
network learns to tell, from a vector, where its neighbours lie. Every vector is indexed in its
likeliest partition. A query goes to the most probable partitions until their probabilities add up
to ``MASS`` and they hold as many vectors as it asks for, so clustered data are searched in few and
shapeless data in many, and what it meets is ranked by the exact inner product, ties to the smaller
id. There are more partitions the larger the table is.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, columns_of, written
from tidemark.llm.vectors import lengths, matrix, sample, usable

#: Vectors the graph is built on at least, and for each partition; its neighbours, hidden units.
SAMPLE, PER_PARTITION, NEIGHBOURS, HIDDEN = 4096, 64, 20, 128
#: Least and most partitions.
PARTITIONS = (16, 256)
#: Probability that the partitions a query goes to must hold together.
MASS = 0.97
#: Indexed vectors, and queries, of one task.
BLOCK, QUERIES = 8192, 8192


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest inner products of each row, itself left out."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05, seed: int = 3) -> np.ndarray:
    """Parts of near-equal size that cut few edges: regions grown from seeds, then refined by gain under a size limit."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(n / parts * slack))
    part = np.full(n, -1)
    sizes = np.zeros(parts, int)
    fronts = [[int(s)] for s in rng.permutation(n)[:parts]]
    free = list(rng.permutation(n))
    while (part < 0).any():
        p = int(sizes.argmin())
        node = -1
        while fronts[p] and node < 0:
            c = fronts[p].pop(0)
            node = c if part[c] < 0 else -1
        while node < 0:
            c = int(free.pop())
            node = c if part[c] < 0 else -1
        part[node] = p
        sizes[p] += 1
        fronts[p] += graph[node].tolist()
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (src, part[dst]), 1)
        np.add.at(votes, (dst, part[src]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < limit:
                sizes[part[v]] -= 1
                part[v] = best[v]
                sizes[part[v]] += 1
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer and a softmax over partitions."""

    def __init__(self, dim: int, parts: int, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(dim), (dim, HIDDEN)) * 2, np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        names = ("w1", "b1", "w2", "b2")
        m, v = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        t = 0
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                a, t = x[idx], t + 1
                h = np.maximum(a @ self.w1 + self.b1, 0)
                z = h @ self.w2 + self.b2
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = (p - target[idx]) / len(idx)
                back = (d @ self.w2.T) * (h > 0)
                grads = {"w2": h.T @ d + 1e-4 * self.w2, "b2": d.sum(0), "w1": a.T @ back + 1e-4 * self.w1, "b1": back.sum(0)}
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grads[k]
                    v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))


def partitions_for(n: int) -> int:
    """Partitions of a table of ``n`` vectors: a quarter of their square root, within bounds."""
    return max(PARTITIONS[0], min(PARTITIONS[1], round(n**0.5 / 4)))


def learn(x: np.ndarray, parts: int) -> tuple[Router, Router]:
    """(assigner, router): the first gives a vector its partition, the second tells where a query's neighbours are indexed."""
    scale = np.linalg.norm(x, axis=1).mean() or 1.0
    x = x / scale
    k = min(NEIGHBOURS, len(x) - 1)
    parts = min(len(x), max(2, min(parts, len(x) // 32)))
    assign, route = Router(x.shape[1], parts), Router(x.shape[1], parts, seed=10)
    assign.scale = route.scale = scale
    if parts == 1:
        return assign, route
    graph = neighbour_graph(x, k)
    part = balanced_partition(graph, parts)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 1 / k)
    own = np.eye(parts)[part]
    assign.train(x, 0.5 * share + 0.5 * own)
    placed = assign.probabilities(x).argmax(1)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), k), placed[graph].ravel()), 1 / k)
    route.train(x, share, epochs=15)
    return assign, route


def _search(dim: int, top: int):
    """A block of a partition against a block of its queries: each query's best."""

    def run(key, table):
        asks = np.asarray(table["asks"].combine_chunks().cast(pa.int8())) > 0
        ids, row = (np.asarray(table[c].combine_chunks()) for c in ("vec_id", "row"))
        x = matrix(table["embedding"], dim)
        q, y = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        y = y[np.lexsort((row[y], ids[y]))]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q) if len(y) else 0, 256):
            rows = q[at : at + 256]
            s = x[rows] @ x[y].T
            s[row[rows][:, None] == row[y][None]] = -np.inf
            k = min(top, len(y)) - 1
            least = np.partition(s, len(y) - 1 - k, axis=1)[:, len(y) - 1 - k]
            least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -1.7e308)
            a, b = np.nonzero(s >= least[:, None])
            exact = np.concatenate([np.zeros(0), *((x[rows[a[c : c + 65536]]] * x[y[b[c : c + 65536]]]).sum(1) for c in range(0, len(a), 65536))])
            order = np.lexsort((b, -exact, a))  # rows stand by id
            a, b, exact = a[order], b[order], exact[order]
            first = np.searchsorted(a, np.arange(len(rows)))
            keep = np.arange(len(a)) - first[a] < top
            a, b = rows[a[keep]], y[b[keep]]
            out.append((row[a], ids[a], row[b], ids[b], exact[keep]))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return pa.table(dict(zip(("query_row", "query_id", "row", "vec_id", "score"), map(pa.array, parts), strict=True)))

    return run


def search(vectors: DataFrame, every: int = 20, top: int = 20, parts: int | None = None, mass: float = MASS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` largest inner products found of each row whose id ``every`` divides.

    Every usable row but the query's own is a candidate. Defined cases: vectors that are null, zero or
    not finite, and null ids, take no part; vectors of different lengths have no inner product, so each
    length is searched by itself; ties go to the smaller id; rows that share an id are rows of their own,
    also as queries; with few rows all are returned; an empty table gives no rows; other columns are
    ignored, also where a name differs in case only.
    """
    good = columns_of(vectors, "vec_id", "embedding").where(usable() & F.col("vec_id").isNotNull())
    found = [_of_length(good.where(F.size("embedding") == dim), dim, every, top, parts, mass) for dim in lengths(good)]
    if not found:
        return good.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0D AS score")
    return reduce(DataFrame.unionByName, found)


def _of_length(good: DataFrame, dim: int, every: int, top: int, parts: int | None, mass: float) -> DataFrame:
    """``search`` among usable vectors that are ``dim`` long, one at least. Written rows keep their numbers, which tell equal ids apart."""
    good = written(good.withColumn("row", F.monotonically_increasing_id()), "vectors")
    parts = parts or partitions_for(good.count())
    x = sample(good, "vec_id", max(SAMPLE, PER_PARTITION * parts))
    assign, route = learn(x, parts)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                home = assign.probabilities(matrix(batch["embedding"], dim) / assign.scale).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *batch.columns], names=["part", *batch.schema.names])

    kind = good.schema["embedding"].dataType.simpleString()
    placed = written(arrow_map(good, place, f"part int, vec_id long, embedding {kind}, row long"), "placed")
    held = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").count().collect():  # PARTITIONS[1] rows at most
        held[r["part"]] = r["count"]

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = route.probabilities(matrix(batch["embedding"], dim) / assign.scale)
            order = np.argsort(-p, axis=1, kind="stable")
            sure, met = np.take_along_axis(p, order, 1), held[order]
            before, seen = np.cumsum(sure, 1) - sure, np.cumsum(met, 1) - met
            r, c = np.nonzero((before < mass) | (seen <= top))  # the query's own row is one of those met
            take = pa.array(r)
            cols = [pa.array(order[r, c].astype(np.int32)), *(batch[name].take(take) for name in ("vec_id", "embedding", "row"))]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "vec_id", "embedding", "row"])

    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding", "row")
    asked = written(arrow_map(queries, ask, f"part int, vec_id long, embedding {kind}, row long"), "asked")
    blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq"))
    blocks = blocks.join(placed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ni")), "part")
    both = placed.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    dealt = both.join(F.broadcast(blocks), "part")  # a row a partition
    own = F.pmod(F.xxhash64("row"), F.when(F.col("asks"), F.col("nq")).otherwise(F.col("ni"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("ni")).otherwise(F.col("nq")) - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumn("i", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own"))).withColumn(
        "q", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))
    )
    found = dealt.select("part", "i", "q", "asks", "vec_id", "row", "embedding").groupBy("part", "i", "q").applyInArrow(
        _search(dim, top), "query_row long, query_id long, row long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
