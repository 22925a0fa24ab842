"""Capacity from single executions: the batch against one execution after the other; writes by gap against a walk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import presence
from tidemark.operators.capacity import Limits, Sliding, learned

SCHEMA = "worker string, job string, start double, complete double, seconds double, dropped double"


def executions(rng: random.Random, n: int, gap: float) -> list[tuple]:
    now, rows = 1000.0, []
    for _ in range(n):
        now += rng.randrange(0, round(gap * 4)) / 2
        long = rng.randrange(1, 9) / 2
        rows.append(("w", f"j{rng.randrange(3)}", now - long, now, long, float(rng.choice([0, 0, 0, 3]))))
        if rng.random() < 0.05:
            now += 90
    return rows


def walked(rows: list[tuple], limits: Limits) -> list[tuple]:
    fold, out = Sliding(limits), []
    for now in sorted({r[3] for r in rows}):
        out += fold.take([r[1:] for r in rows if r[3] == now])
    return out


def near(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize(("gap", "limits"), [(3.0, Limits(part=100.0)), (1.0, Limits(window=20.0, warm_up=1, part=20.0)), (6.0, Limits(target=0.5, busy=0.6, dropped=0.3, samples=2, least=3, part=10_000.0)), (2.0, Limits(pin=7))])
def test_batch_is_the_walk(spark, gap, limits):
    rng = random.Random(gap)
    rows = executions(rng, 300, gap)
    other = [("v", *r[1:]) for r in executions(rng, 40, gap)]
    got = learned(spark.createDataFrame(rows + other, SCHEMA).repartition(3), limits).collect()
    columns = ("job", "complete", "busy", "drop_share", "clean", "cost", "ceiling", "capacity")
    for worker, own in (("w", rows), ("v", other)):
        assert near([tuple(r[c] for c in columns) for r in got if r["worker"] == worker]) == near(walked(own, limits))
    assert any(r["clean"] for r in got) and not all(r["clean"] for r in got)


def test_what_a_window_says():
    limits = Limits(warm_up=0, samples=2)
    fold = Sliding(limits)
    assert fold.take([("a", 0.0, 6.0, 6.0, 0.0)]) == [("a", 6.0, None, 0.0, False, None, None, None)]  # one execution has no idle time to show
    (job, _, busy, _, clean, cost, ceiling, capacity), = fold.take([("b", 24.0, 30.0, 6.0, 0.0)])
    assert (busy, clean, cost, ceiling, capacity) == (0.4, True, 0.2, 4, None)  # one clean window is not enough
    assert fold.take([("a", 30.0, 36.0, 6.0, 0.0)])[0][-1] == 3
    overrun = [fold.take([("a", 36.0 + k, 37.0 + k, 1.0, 9.0)])[0] for k in range(5)]
    assert {r[4] for r in overrun} == {False} and {r[6] for r in overrun} == {3}  # drops never raise it
    assert len(fold.kept) == 8
    fold.take([("c", 300.0, 301.0, 1.0, 0.0)])
    fold.take([("c", 301.0, 302.0, 1.0, 0.0)])
    assert len(fold.kept) == 2 and set(fold.jobs) == {"c"}  # nothing of what came before the window


def chain(times: list[float], interval: float) -> list[float]:
    out: list[float] = []
    for t in sorted(times):
        if not out or t >= out[-1] + interval:
            out.append(t)
    return out


@pytest.mark.parametrize("part", [None, 10.0, 37.0])
def test_writes_are_an_interval_apart(spark, part):
    rng = random.Random(5)
    touches = {"slot edge": [0.0, 9.5, 10.0, 10.5, 19.5, 20.0], "one": [3.0], "same": [1.0, 1.0, 1.0], "sparse": [0.0, 500.0, 505.0, 2000.0], "before zero": [-25.0, -12.0, -3.0, 4.0]}
    touches |= {f"r{k}": [rng.randrange(0, 4000) / 2 for _ in range(rng.randrange(1, 400))] for k in range(5)}
    rows = [(k, t) for k, ts in touches.items() for t in ts] + [("never", None)]
    got: dict[str, list[float]] = {}
    for r in presence.coalesced(spark.createDataFrame(rows, "device string, at double"), "device", "at", 10.0, part).collect():
        got.setdefault(r["device"], []).append(r["last_seen"])
    assert {k: sorted(v) for k, v in got.items()} == {k: chain(ts, 10.0) for k, ts in touches.items()}


def test_online(spark):
    row = spark.range(1).select(*(presence.online(F.lit(v).cast("double"), F.lit(100.0), 30.0).alias(n) for n, v in (("a", 70.0), ("b", 69.0), ("c", None)))).first()
    assert (row["a"], row["b"], row["c"]) == (True, False, False)
