"""Embedding near-duplicates by product quantisation.

Coarse centroids make inverted lists; the residual of each vector is coded by subspace. A vector
probes the lists whose border is close enough: two vectors of cosine c lie |x - y| = sqrt(2 - 2c)
apart on the sphere, and the border plane of two lists between them cuts that distance, so one of
the two is within half of it. Probing lists with a border so near loses no link. In a list,
asymmetric distances from lookup tables rule out candidates: a code's own error is stored, and by
the triangle inequality a true link cannot look farther than the bound plus that error. What is
left is compared exactly, in double precision.

Lists that lie close together form a region, to which a vector is sent once, whatever number of its
lists it probes. Equal vectors are one class. Regions of any size are cut into blocks that are compared
in separate tasks, which fold what they find into counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, columns_of, drop_written, written
from tidemark.llm.components import connected_components, local_labels
from tidemark.llm.vectors import lengths, matrix, sample, usable

#: Vectors that the quantisers are fitted on at least, and for each list; coarse lists, subspaces, codewords of each.
SAMPLE, PER_LIST, MAX_LISTS, SUBSPACES, CODEWORDS = 8192, 8, 4096, 8, 64
#: Lists of a region.
REGION = 16
#: Vectors of a region, and vectors that probe it, of one task.
BLOCK, PROBING = 4096, 16384
#: Cells of a matrix of distances that the driver holds at once.
CELLS = 1 << 22
#: Links of a task that are held before they are folded.
PAIRS = 1 << 20
EPS = 1e-9


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of ``c`` that is closest to each of ``x``, some rows at a time."""
    rows, half = max(1, CELLS // max(1, len(c))), (c * c).sum(1) / 2
    return np.concatenate([np.zeros(0, int), *((x[k : k + rows] @ c.T - half).argmax(1) for k in range(0, len(x), rows))])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        for d in range(x.shape[1]):
            s = np.bincount(near, x[:, d], len(c))
            n = np.bincount(near, minlength=len(c))
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
    return c


class Quantiser:
    def __init__(self, unit: np.ndarray, lists: int) -> None:
        self.coarse = kmeans(unit, max(1, min(lists, len(unit))))
        rest = unit - self.coarse[_nearest(unit, self.coarse)]
        dim = unit.shape[1]
        self.cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        regions = max(1, -(-len(self.coarse) // REGION))
        middles = kmeans(self.coarse, regions, seed=7)
        self.region = _nearest(self.coarse, middles)
        self.books = [kmeans(rest[:, a:b], min(CODEWORDS, len(rest)), seed=k) for k, (a, b) in enumerate(self.parts)]

    @property
    def parts(self) -> list[tuple[int, int]]:
        return list(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True))

    def squares(self, unit: np.ndarray) -> np.ndarray:
        return 1 - 2 * unit @ self.coarse.T + (self.coarse**2).sum(1)

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances of the lists' centroids from each other, found once a task."""
        if len(self.coarse) <= 64:
            return np.sqrt(((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2))
        own = (self.coarse**2).sum(1)
        return np.sqrt(np.maximum(own[:, None] + own - 2 * self.coarse @ self.coarse.T, 0))

    def probes(self, unit: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Home list, and for each row and list whether the border between it and home is within ``reach``."""
        sq = self.squares(unit)
        home = sq.argmin(1)
        gap = sq - sq[np.arange(len(sq)), home][:, None]
        near = gap <= 2 * self.apart[home] * (reach + EPS) + EPS
        near[np.arange(len(sq)), home] = False
        return home, near

    def encode(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distance of each vector from what its code stands for."""
        rest = unit - self.coarse[home]
        codes = np.zeros((len(unit), len(self.books)), np.uint8)
        error = np.zeros(len(unit))
        for m, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            far = (rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(1)
            codes[:, m] = far.argmin(1)
            error += np.maximum(far.min(1), 0)
        return codes, np.sqrt(error)

    def asymmetric(self, unit: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of vectors from coded ones of a list, from one lookup table a subspace."""
        rest = unit - self.coarse[which]
        out = np.zeros((len(unit), len(codes)), np.float32)
        for m, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            table = ((rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(1)).astype(np.float32)
            out += table[:, codes[:, m]]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(quantiser: Quantiser, dim: int, reach: float):
    """Every class in its region, and once in each region that has lists it probes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield told(batch.slice(at, 1024))

    def told(batch):
        unit = _unit(matrix(batch["embedding"], dim))
        home, near = quantiser.probes(unit, reach)
        codes, error = quantiser.encode(unit, home)
        row, probe = np.nonzero(near)
        by = np.lexsort((quantiser.region[probe], row))
        row, probe = row[by], probe[by]
        region = quantiser.region[probe]
        new = np.nonzero(np.append(True, (row[1:] != row[:-1]) | (region[1:] != region[:-1])))[0] if len(row) else np.zeros(0, int)
        n, m = len(unit), len(new)
        take = pa.array(np.concatenate([np.arange(n), row[new]]))
        # of a row at home all the lists it probes, of a row elsewhere those there
        bounds = np.concatenate([[0], np.cumsum(near.sum(1)), len(probe) + np.append(new[1:], len(probe) if m else [])[:m]])
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate([probe, probe]).astype(np.int32)))
        cols = {
            "region": pa.array(np.concatenate([quantiser.region[home], region[new]]).astype(np.int32)), "probing": pa.array(np.arange(n + m) >= n),
            "node": batch["node"].take(take), "mult": batch["mult"].take(take), "embedding": batch["embedding"].take(take),
            "home": pa.array(home).cast(pa.int32()).take(take), "code": pa.array([c.tobytes() for c in codes], pa.binary()).take(take),
            "error": pa.array(error).take(take), "probes": lists,
        }
        return pa.RecordBatch.from_pydict(cols)

    return run


class _Links:
    """Links of a task by row numbers: how many each row has, and what connects them."""

    def __init__(self, mult: np.ndarray) -> None:
        self.mult, self.count, self.held = mult, np.zeros(len(mult), np.int64), 0
        self.i, self.j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.mult[j])
        np.add.at(self.count, j, self.mult[i])
        self.i.append(i)
        self.j.append(j)
        self.held += len(i)
        if self.held > PAIRS:
            self.fold()

    def fold(self) -> np.ndarray:
        """Smallest row that each is connected with; what is held shrinks to a forest."""
        lab = local_labels(len(self.mult), np.concatenate(self.i), np.concatenate(self.j))
        on = np.nonzero(lab != np.arange(len(lab)))[0]
        self.i, self.j, self.held = [on], [lab[on]], len(on)
        return lab


def _compare(quantiser: Quantiser, dim: int, cosine: float):
    """One task: links counted by class, and a forest of them. Kind 0 compares a region's vectors of one list, kind 1 those that probe with those probed."""
    bound = np.sqrt(2 - 2 * cosine)

    def run(key, table):
        _, kind, p, q = (k.as_py() for k in key)
        unit = _unit(matrix(table["embedding"], dim))
        node, mult = (np.asarray(table[c].combine_chunks()) for c in ("node", "mult"))
        probing, own = np.asarray(table["probing"].combine_chunks().cast(pa.int8())) > 0, np.asarray(table["own"].combine_chunks())
        home, probes = np.asarray(table["home"].combine_chunks()), table["probes"].combine_chunks()
        codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(node), -1)
        error = np.asarray(table["error"].combine_chunks())
        here = np.nonzero(~probing)[0]
        here = here[np.lexsort((node[here], home[here]))]
        links = _Links(mult)
        if kind:
            size = np.diff(np.asarray(probes.offsets))
            asked = np.asarray(probes.values)[: size.sum()] if probes.offset == 0 else np.asarray(probes.flatten())
            who = np.repeat(np.arange(len(node)), size)
            on = probing[who]
            who, asked = who[on], asked[on]
            by = np.argsort(asked, kind="stable")
            who, asked = who[by], asked[by]
            back: dict[int, set[int]] = {}
        for which in np.unique(home[here]).tolist():
            right = here[np.searchsorted(home[here], which) : np.searchsorted(home[here], which, side="right")]
            if kind:
                left = who[np.searchsorted(asked, which) : np.searchsorted(asked, which, side="right")]
            elif p == q:
                left = right
            else:
                left, right = right[own[right] == p], right[own[right] == q]
            for at in range(0, len(left) if len(right) else 0, 512):
                rows = left[at : at + 512]
                far = quantiser.asymmetric(unit[rows], which, codes[right])
                a, b = np.nonzero(far <= ((bound + error[right]) ** 2 + 1e-4).astype(np.float32))
                a, b = rows[a], right[b]
                if not kind and p == q:
                    a, b = a[node[a] < node[b]], b[node[a] < node[b]]
                for s in range(0, len(a), 1 << 16):
                    x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                    hit = (unit[x] * unit[y]).sum(1) >= cosine
                    x, y = x[hit], y[hit]
                    if kind and len(x):  # a pair that each finds from its side counts where the smaller one probes
                        back |= {k: set(probes[k].as_py()) for k in np.unique(y).tolist() if k not in back}
                        both = np.array([h in back[k] for h, k in zip(home[x].tolist(), y.tolist(), strict=True)])
                        keep = ~both | (node[x] < node[y])
                        x, y = x[keep], y[keep]
                    links.add(x, y)
        lab = links.fold()
        on = np.nonzero(links.count > 0)[0]
        return pa.table({"a": pa.array(node[on]), "b": pa.array(node[lab[on]]), "n": pa.array(links.count[on])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, lists: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Defined cases: vectors that are null, zero or not finite link with nothing: no links, a component of
    their own, kept. Vectors of different lengths do not link; each length is searched by itself. Equal
    vectors link with each other. A null vec_id takes no part and gives null. Repeated ids: rows of one id
    and vector are rows of one class. An empty table gives no rows; other columns are ignored, also where
    a name differs in case only.
    """
    rows = columns_of(vectors, "vec_id", "embedding")
    fit = usable() & F.col("vec_id").isNotNull()
    good = rows.where(fit)
    parts = [_of_length(good.where(F.size("embedding") == dim), dim, cosine, lists, block) for dim in lengths(good)]
    rest = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = reduce(DataFrame.unionByName, parts, rest)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _of_length(good: DataFrame, dim: int, cosine: float, lists: int | None, block: int) -> DataFrame:
    """vec_id, n_links, component_id of usable vectors that are ``dim`` long, one at least."""
    classes = written(good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult")), "classes")
    members = good.join(classes, "embedding").select("vec_id", "node", "mult")
    n = classes.count()
    k = lists or max(1, min(MAX_LISTS, round(n**0.5)))
    quantiser = Quantiser(_unit(sample(classes, "node", max(SAMPLE, PER_LIST * k))), k)
    reach = float(np.sqrt(2 - 2 * cosine)) / 2
    kind = classes.schema["embedding"].dataType.simpleString()
    indexed = arrow_map(
        classes.select("node", "mult", "embedding"), _index(quantiser, dim, reach),
        f"region int, probing boolean, node long, mult long, embedding {kind}, home int, code binary, error double, probes array<int>",
    )
    indexed = written(indexed, "lists")
    sizes = indexed.groupBy("region").agg(
        F.ceil(F.sum((~F.col("probing")).cast("long")) / block).cast("int").alias("ni"),
        F.ceil(F.sum(F.col("probing").cast("long")) / (block * PROBING // BLOCK)).cast("int").alias("nq"),
    )
    # a row a region, MAX_LISTS at most
    dealt = indexed.join(F.broadcast(sizes), "region").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.when(F.col("probing"), F.col("nq")).otherwise(F.col("ni"))).cast("int")
    )
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    inner = dealt.where("not probing and ni > 0").withColumn("o", F.explode(upto(F.col("ni"))))
    inner = inner.select("*", F.lit(0).alias("kind"), F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"))
    held = dealt.where("not probing and nq > 0").withColumn("o", F.explode(upto(F.col("nq"))))
    held = held.select("*", F.lit(1).alias("kind"), F.col("own").alias("p"), F.col("o").alias("q"))
    asked = dealt.where("probing and ni > 0").withColumn("o", F.explode(upto(F.col("ni"))))
    asked = asked.select("*", F.lit(1).alias("kind"), F.col("o").alias("p"), F.col("own").alias("q"))
    tasks = inner.unionByName(held).unionByName(asked)
    found = tasks.groupBy("region", "kind", "p", "q").applyInArrow(_compare(quantiser, dim, cosine), "a long, b long, n long")
    found = written(found, "links")
    drop_written(indexed)
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.select("a", "b"))
    members = members.join(counts, "node", "left").join(roots, "node", "left")
    return members.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
