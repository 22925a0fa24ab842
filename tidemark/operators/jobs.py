"""The plug-in surface: jobs with configurations and counters, providers by name, a summariser that recurses."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.transcript import split_text

#: Letters of a section that a summariser takes, and most passes over its own summaries.
SECTION, PASSES = 12_000, 5


class Job(Protocol):
    """What runs a key's batches: one instance a key, made where the key's rows are."""

    def process(self, batch: pd.DataFrame) -> pd.DataFrame: ...

    def configure(self, config: str) -> None: ...

    def drain(self) -> dict[str, float]:
        """Counts since the last call; they are taken after every batch, also one that failed."""
        ...


class Counters:
    """Named counts of a job, drained a batch at a time."""

    def __init__(self) -> None:
        self._now: dict[str, float] = {}

    def add(self, name: str, by: float = 1.0) -> None:
        self._now[name] = self._now.get(name, 0.0) + by

    def drain(self) -> dict[str, float]:
        out, self._now = self._now, {}
        return out


def ran(messages: DataFrame, keys: list[str], order: str, factory: Callable[[], Job], schema: str) -> DataFrame:
    """Results of jobs over messages (keys, order, batch, config?): a batch is what came between two runs, a config a message of its own.

    A result row is of ``schema``; counters are rows with ``counter`` and ``delta``. An error ends the key's job: its last row
    says what it was, and the counters up to then are still told.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    extra = ["counter", "delta", "error"]
    kinds = ", ".join(f"{k} {messages.schema[k].dataType.simpleString()}" for k in keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        job, parts = factory(), []
        frame = frame.sort_values(order)
        runs = (frame["batch"] != frame["batch"].shift()) | frame["config"].notna() | frame["config"].shift().notna()
        for _, part in frame.groupby(runs.cumsum(), sort=True):
            fault = None
            try:
                if pd.notna(part["config"].iloc[0]):
                    job.configure(part["config"].iloc[0])
                    continue
                parts.append(job.process(part).reindex(columns=[*names, *extra]))
            except Exception as e:  # noqa: BLE001 - the job ends, whatever it raised
                fault = f"{type(e).__name__}: {e}"
            rows = [{"counter": n, "delta": float(d)} for n, d in sorted(job.drain().items())]
            rows += [{"error": fault}] if fault else []
            if rows:
                parts.append(pd.DataFrame(rows).reindex(columns=[*names, *extra]))
            if fault:
                break
        parts = [p for p in parts if len(p)]
        out = pd.concat(parts).astype(object) if parts else pd.DataFrame(columns=[*names, *extra])
        out = out.where(out.notna(), None)
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out[[*keys, *names, *extra]]

    return messages.groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}, counter string, delta double, error string")


def observed(df: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    """``df`` with counts that are known once an action has run over it, without a pass of their own."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in counts.items())), seen


class Providers:
    """Steps by the key under which a configuration names them."""

    def __init__(self) -> None:
        self._by: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, key: str, step: Callable[[DataFrame], DataFrame]) -> None:
        if key in self._by:
            raise ValueError(f"provider {key} is there already")
        self._by[key] = step

    def keys(self) -> list[str]:
        return sorted(self._by)

    def applied(self, df: DataFrame, column: str) -> DataFrame:
        """Rows through the provider that their column names; others are left out, as a host refuses keys that it doesn't serve."""
        if not self._by:
            raise ValueError("no provider")
        parts = [step(df.where(F.col(column) == key)) for key, step in sorted(self._by.items())]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def refused(self, df: DataFrame, column: str) -> DataFrame:
        return df.where(~F.coalesce(F.col(column).isin(self.keys()), F.lit(False)))


def summarised(text: str, model: Callable[[str], str], limit: int = SECTION, passes: int = PASSES) -> tuple[str | None, int, int, bool]:
    """(summary, sections of the first pass, passes, converged): sections are summarised, and their summaries again, until one is left.

    A pass that makes the text no shorter is the last one, and what it gave is the result.
    """
    first = 0
    for n in range(1, passes + 1):
        parts = split_text(text, limit)
        first = first or len(parts)
        if not parts:
            return None, first, n, False
        told = [t for p in parts if (t := model(p).strip())]
        joined = "\n\n".join(told)
        if len(parts) == 1 or not told:
            return joined or None, first, n, bool(told)
        if len(joined) >= len(text):
            return joined, first, n, False
        text = joined
    return text, first, passes, False


def summaries(df: DataFrame, key: str, text: str, model: Callable[[str], str], limit: int = SECTION) -> DataFrame:
    """(key, summary, sections, passes, converged) of every text; ``model`` goes to the tasks."""

    def run(frames):
        for f in frames:
            rows = [(k, *summarised(t or "", model, limit)) for k, t in zip(f[key], f[text], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "summary", "sections", "passes", "converged"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, summary string, sections int, passes int, converged boolean")


def next_jobs(entries: DataFrame, now: Column) -> DataFrame:
    """(worker, job, deadline, idle): what each worker does next.

    ``entries``: worker, job (null: a worker without jobs), state, period_start, period. A sleeping job is ready once its period has
    begun; of ready jobs the one with the earliest deadline runs, the end of its period, ties to the smaller job. Without a ready job the
    worker idles until the first sleeping one's period begins, without a sleeping one for good (null).
    """
    sleeping = F.col("state") == "SLEEPING"
    ready = (F.col("state") == "READY") | (sleeping & (F.col("period_start") < now))
    end = F.col("period_start") + F.col("period")
    best = F.min(F.when(ready, F.struct(end.alias("deadline"), F.col("job").alias("job"))))
    got = entries.groupBy("worker").agg(best.alias("_b"), F.min(F.when(sleeping, F.col("period_start"))).alias("_s"))
    return got.select("worker", "_b.job", "_b.deadline", F.when(F.col("_b").isNull(), F.col("_s") - now).alias("idle"))
