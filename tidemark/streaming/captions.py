"""Captions and their speakers on live streams: the folds of ``operators.captions``, with their state in the state store.

Rows of a session may come in any order within the watermark's delay. They wait in state until the
watermark has passed them and are then taken in the order of their time, so a stream gives what a batch
over the same rows gives. What a session keeps is bounded: rows that wait by the delay, words that wait
by their timeout, a timeline by its history, drafts by the audio buffer they cover; a session that
nobody hears of for ``forget`` seconds leaves nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.captions import EVENT, UPDATES, Drafts, Timeline

#: Seconds of silence after which a session is forgotten.
FORGET = 24 * 3600.0


def _ms(seconds: float) -> int:
    return math.ceil(seconds * 1000)


class InOrder(StatefulProcessor):
    """Gives the rows of a key to ``step`` in the order of (at, seq), once the watermark has passed them.

    ``columns`` are those of what ``step`` yields, after the key. ``due`` is the next instant at which something happens without a row.
    """

    columns: list[str]

    def __init__(self, key: str, forget: float = FORGET) -> None:
        self.key, self.forget = key, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at long, seq long", "row string")
        self.last = handle.getValueState("last", "at double")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, rows: list[dict], until: float) -> Iterator[tuple]:
        raise NotImplementedError

    def due(self) -> float | None:
        return None

    def clear(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        instants = set()
        for frame in rows:
            for at, seq, row in frame[["at", "seq", "row"]].itertuples(index=False):
                self.held.updateValue((int(at), int(seq)), (row,))
                instants.add(int(at))
        for at in instants:
            self.handle.registerTimer(at)
        yield pd.DataFrame([], columns=[self.key, *self.columns])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = max(int(expiredTimerInfo.getExpiryTimeInMs()), 0)
        ready = sorted((k, row) for k, (row,) in ((tuple(k), v) for k, v in self.held.iterator()) if k[0] <= upto)
        out = [(key[0], *r) for r in self.step([json.loads(row) | {"seq": k[1]} for k, row in ready], upto / 1000)]
        for k, _ in ready:
            self.held.removeKey(k)
        if ready:
            heard = ready[-1][0][0] / 1000
            self.last.update((heard,))
            self.handle.registerTimer(_ms(heard + self.forget))
        elif self.last.exists() and upto / 1000 >= self.last.get()[0] + self.forget and self.due() is None:
            self.clear()
            self.last.clear()
        if (due := self.due()) is not None and _ms(due) > upto:
            self.handle.registerTimer(_ms(due))
        yield pd.DataFrame(out, columns=[self.key, *self.columns])

    def close(self) -> None:
        return


class LiveTimeline(InOrder):
    """``Timeline`` with its spans in list state, what waits in map state, and timers for what runs out."""

    columns = ["at", "name", "speakers", "settled"]

    def __init__(self, key: str, settings: dict, forget: float = FORGET) -> None:
        super().__init__(key, forget)
        self.settings = settings

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getListState("spans", "start double, end double, speaker string, sure double")
        self.waiting = handle.getMapState("waiting", "name string", "times string, speakers string, first int, sent double")
        self.clock = handle.getValueState("clock", "through double, revisions int, revised double")

    def _load(self) -> Timeline:
        line = Timeline(**self.settings)
        line.spans = [tuple(s) for s in self.spans.get()] if self.spans.exists() else []
        if self.clock.exists():
            line.through, line.revisions, line.revised = self.clock.get()
        for (name,), (times, speakers, first, sent) in self.waiting.iterator():
            line.waiting[name] = ([tuple(t) for t in json.loads(times)], json.loads(speakers), first, sent)
        return line

    def _store(self, line: Timeline, known: set[str]) -> None:
        if line.spans:
            self.spans.put([tuple(s) for s in line.spans])
        else:
            self.spans.clear()
        self.clock.update((float(line.through), int(line.revisions), float(line.revised)))
        for name in known - line.waiting.keys():
            self.waiting.removeKey((name,))
        for name, (times, speakers, first, sent) in line.waiting.items():
            self.waiting.updateValue((name,), (json.dumps(times), json.dumps(speakers), int(first), float(sent)))

    def step(self, rows: list[dict], until: float) -> Iterator[tuple]:
        line = self._load()
        known = set(line.waiting)
        said = [u for r in rows for u in line.take({c: r.get(c) for c in ("seq", *EVENT)})]
        said += line.before(math.nextafter(until, math.inf))
        self._store(line, known)
        for at, (name, speakers, settled) in said:
            yield at, name, speakers, settled

    def due(self) -> float | None:
        timeout = self.settings.get("timeout", Timeline.timeout)
        return min((v[3] + timeout for _, v in self.waiting.iterator()), default=None)

    def clear(self) -> None:
        for state in (self.spans, self.waiting, self.clock):
            state.clear()


class LiveDrafts(InOrder):
    """``Drafts`` with its stable words and the drafts still compared in list states."""

    columns = ["seq", "final", "final_end", "in_progress", "forced"]

    def __init__(self, key: str, n: int, forget: float = FORGET) -> None:
        super().__init__(key, forget)
        self.n = n

    def open(self, handle: StatefulProcessorHandle) -> None:
        word = "text string, start double, end double"
        self.stable = handle.getListState("stable", word)
        self.recent = handle.getListState("recent", f"draft int, {word}")
        self.drafts = handle.getValueState("drafts", "n int, through double")

    def step(self, rows: list[dict], until: float) -> Iterator[tuple]:
        fold = Drafts(self.n)
        if self.drafts.exists():
            n, fold.through = self.drafts.get()
            fold.stable = [tuple(w) for w in self.stable.get()] if self.stable.exists() else []
            fold.recent = [[] for _ in range(n)]
            for draft, *word in self.recent.get() if self.recent.exists() else []:
                fold.recent[draft].append(tuple(word))
        for r in rows:
            words = [(w.get("text"), float(w["start"]), float(w["end"])) for w in r.get("words") or []]
            full = r.get("full_until")
            final, open_, forced = fold.step(words, None if full is None else float(full))
            text = lambda ws: "".join(w[0] for w in ws) if ws else None
            yield r["seq"], text(final), final[-1][2] if final else None, text(open_), forced
        self.drafts.update((len(fold.recent), float(fold.through)))
        for state, values in ((self.stable, fold.stable), (self.recent, [(k, *w) for k, ws in enumerate(fold.recent) for w in ws])):
            if values:
                state.put(values)
            else:
                state.clear()

    def clear(self) -> None:
        for state in (self.stable, self.recent, self.drafts):
            state.clear()


def _waiting_rows(stream: DataFrame, ts: str, late: str, columns: list[str]) -> DataFrame:
    """(session, at ms, seq, row) under a watermark; a row's values are one JSON text until its turn comes."""
    ms = F.unix_micros(ts) / 1000
    return stream.withWatermark(ts, late).select("session", ts, F.ceil(ms).cast("long").alias("at"), "seq", F.to_json(F.struct(*columns)).alias("row"))


def live_labels(events: DataFrame, ts: str, late: str, forget: float = FORGET, **settings: float) -> DataFrame:
    """What ``captions.labelled_sequences`` says, as soon as the watermark allows; an event's clock (``now``, seconds since 1970) is ``ts``.

    Needs a state store with column families. Rows that come after the watermark are dropped.
    """
    kind = events.schema["session"].dataType.simpleString()
    rows = _waiting_rows(events.withColumn("now", F.unix_micros(ts) / 1_000_000), ts, late, list(EVENT))
    return rows.groupBy("session").transformWithStateInPandas(LiveTimeline("session", settings, forget), f"session {kind}, {UPDATES}", "Append", "EventTime")


def live_captions(drafts: DataFrame, ts: str, late: str, n: int = 2, forget: float = FORGET) -> DataFrame:
    """What ``captions.caption_steps`` says of drafts (session, seq, words, full_until) with a time ``ts`` each."""
    kind = drafts.schema["session"].dataType.simpleString()
    rows = _waiting_rows(drafts, ts, late, ["words", "full_until"])
    out = f"session {kind}, seq long, final string, final_end double, in_progress string, forced boolean"
    return rows.groupBy("session").transformWithStateInPandas(LiveDrafts("session", n, forget), out, "Append", "EventTime")
