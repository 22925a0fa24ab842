"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, written


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` has two long columns, a and b, in any order and with repeats. A round relinks the
    neighbours of every node to its smallest neighbour, which needs logarithmically many rounds.
    Minima are pre-aggregated before the shuffle and the joins are inner joins, which adaptive
    execution splits where one node has most edges. Each round is a table in the shared folder.
    """
    cur = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(cur)
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_mins(both).select("a", F.least("a", "m").alias("m")), "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large = written(large, "large")
        small = large.join(_mins(large), "a")
        step = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = step.unionByName(_mins(large).select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = written(step, "small")
        drop_written(large)
        drop_written(cur)
        cur, before, state = nxt, state, _state(nxt)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    out._tidemark_path = cur._tidemark_path
    return out


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and edges i-j, the smallest node of each node's component."""
    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        new = new[new]
        while not np.array_equal(new, hop := new[new]):
            new = hop
        lab = new[lab]
        open_ = lab[i] != lab[j]
        if not open_.any():
            break
        i, j = i[open_], j[open_]
    return lab
