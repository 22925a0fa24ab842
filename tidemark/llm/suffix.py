"""Removal of long repeated passages by sparse suffix arrays.

Of all word suffixes only those at minimisers are retained: for a passage that starts at word s,
the place of the smallest hash of eight words among the sixteen places from s on. The choice
depends on the words alone, so equal passages retain equal suffixes. The retained suffixes are
sorted by their first 35 words and compared with their neighbours; a match is extended left, to
every start that has this minimiser, and right, to the passage's full length, and the extended
passages are again sorted and compared with their neighbours. What follows an equal neighbour is a
repeat; the first place, by doc_id and position, stays.

Both sorts are range-partitioned by content and then place, so a passage that a third of all
documents hold is spread over many tasks; a task compares row with row and remembers one. Where
tasks meet, one row of each side is compared on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, drop_written, restored, shielded, text_slices, written

#: Words of a passage that counts as repeated.
PASSAGE = 50
#: Words of the hash that selects suffixes, and places among which the smallest is taken.
GRAM, SPAN = 8, 16

#: Bytes of text whose letters are hashed at once.
LETTERS = 1 << 18
#: Independent 64-bit hashes of a passage that must all be equal.
LANES = 2

_RNG = np.random.default_rng(20_011)
_BYTE = _RNG.integers(1, 1 << 63, (LANES, 256), dtype=np.uint64)
_STEP = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(max(0, n - 1), np.uint64(base)))) if n else np.zeros(0, np.uint64)


_OFFSET = [_powers(b, _STEP) for b in (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)]
_BASE = (0xAF251AF3B0F025B5, 0xDA942042E4DD58B5)
_INVERSE = [pow(b, -1, 1 << 64) for b in _BASE]


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Words:
    """The words of several texts, runs of bytes other than ASCII white space: places, hashes, and each text's first and last.

    Letters are hashed in blocks, so that what is held counts by words and not by bytes.
    """

    def __init__(self, texts: list[bytes], lanes: int = 1) -> None:
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        self.start, self.end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        del blank, edge
        n = len(self.start)
        hashes = np.zeros((lanes, n), np.uint64)
        at = 0
        while at < n:  # some words, one at least
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + LETTERS, side="right")))
            hashes[:, at:to] = self._letters(raw, self.start[at:to], self.end[at:to], lanes)
            at = to
        self.hash = hashes[0]
        with np.errstate(over="ignore"):
            self._sum = [np.append(np.uint64(0), np.cumsum(h * _powers(b, n), dtype=np.uint64)) for h, b in zip(hashes, _BASE, strict=False)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text_at = np.append(0, ends[:-1])
        self.first = np.searchsorted(self.start, self.text_at)
        self.last = np.append(self.first[1:], n)

    @staticmethod
    def _letters(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int) -> list[np.ndarray]:
        size = end - start
        firsts = np.cumsum(size) - size
        off = np.arange(size.sum()) - np.repeat(firsts, size)
        letter = raw[np.repeat(start, size) + off]
        with np.errstate(over="ignore"):
            far = (off >> 16).astype(np.uint64) * _ODD
            off &= _STEP - 1
            sums = [np.add.reduceat(_BYTE[k][letter] * _OFFSET[k][off] + far, firsts) for k in range(lanes)]
            return [_mixed(_mixed(x) + size.astype(np.uint64)) for x in sums]

    def window(self, length: int, lane: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each place on; places too near the end of all have none."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return _mixed((self._sum[lane][length:] - self._sum[lane][:n]) * _powers(_INVERSE[lane], n))

    def anchors(self, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
        """Passage starts inside one text, and the minimiser place of each."""
        gram = self.window(GRAM)
        n = len(gram)
        place = np.arange(n)
        step = 1
        while step < SPAN and n > step:
            later = place[step:]
            here = place[: n - step]
            place = np.concatenate([np.where(gram[later] < gram[here], later, here), place[n - step :]])
            step *= 2
        counts = np.maximum(0, self.last - self.first - passage + 1)
        starts = np.repeat(self.first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return starts, place[starts]


def _as_numbers(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Arrays that are all equal between two rows where the column is, nulls being equal to each other."""
    column = column.combine_chunks()
    if not column.null_count:
        return [np.asarray(column)]
    none = column.is_null()
    filled = column.drop_null()
    if not len(filled):
        return [np.asarray(none)]
    return [np.asarray(pc.fill_null(column, filled[0])), np.asarray(none)]


def _neighbours(df: DataFrame, keys: list[str], order: list[str], both: bool, tag: str) -> DataFrame:
    """Rows of ``df`` whose keys equal those of the row before (with ``both``, or after) in the order of keys and ``order``; their keys are null."""
    names = df.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: pa.Table | None = None  # the last row, not yet told whether it repeats what follows
        held_on = first = True

        def told(table: pa.Table, kind: np.ndarray) -> pa.RecordBatch:
            if not kind.any():  # only the rows at the edges are compared again
                for k in keys:
                    table = table.set_column(table.schema.get_field_index(k), k, pa.nulls(len(table), pa.int64()))
            table = table.append_column("_kind", pa.array(kind.astype(np.int32))).append_column(
                "_part", pa.array(np.full(len(table), part, np.int32))
            )
            return table.combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            values = [np.asarray(table[k].combine_chunks()) for k in keys]
            same = np.logical_and.reduce([v[1:] == v[:-1] for v in values])
            on = np.append(held_on if held is not None else False, same)
            if both:
                on[:-1] |= same
            else:  # equal rows are one place: they are told what the first of them is
                place = [x for c in order for x in _as_numbers(table[c])]
                equal = np.logical_and.reduce([same, *(x[1:] == x[:-1] for x in place)])
                lead = np.maximum.accumulate(np.where(np.append(False, equal), 0, np.arange(len(on))))
                on = on[lead]
            if first:  # kind 1: the first row of a task, 2: the last one
                yield told(table.slice(0, 1), np.array([1]))
            first = False
            if (hits := table.slice(0, len(table) - 1).filter(pa.array(on[:-1]))).num_rows:
                yield told(hits, np.zeros(len(hits)))
            held, held_on = table.slice(len(table) - 1), bool(on[-1])
        if held is not None:
            yield told(held, np.array([2]))
            if held_on:
                yield told(held, np.array([0]))

    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    found = written(arrow_map(rows, run, f"{fields}, _kind int, _part int"), tag)
    # two rows a task
    edges = sorted(found.where("_kind > 0").collect(), key=lambda r: (r["_part"], r["_kind"]))
    missed = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a["_kind"] == 2 and b["_kind"] == 1 and all(a[k] == b[k] for k in keys):
            missed += [b, a] if both else [b]
    out = found.where("_kind = 0").select(*names)
    if missed:
        out = out.unionByName(df.sparkSession.createDataFrame([tuple(None if c in keys else r[c] for c in names) for r in missed], df.schema)).distinct()
    out._tidemark_path = found._tidemark_path
    return out


def _tag(docs: DataFrame) -> Column:
    """What tells rows of one doc_id apart: the text's hash, or zero where no id comes twice."""
    alone = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return F.lit(0).cast("long") if alone else F.xxhash64("text")


def repeated_places(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, _h, at): word places at which a passage starts that an earlier place has too.

    ``docs`` has doc_id, text and _h, what ``_tag`` gives.
    """
    key_words = passage - SPAN + 1
    base = docs.select("doc_id", "text", "_h")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = Words([(t or "").encode() for t in batch["text"].to_pylist()])
            _, place = words.anchors(passage)
            place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
            doc = np.searchsorted(words.first, place, side="right") - 1
            # texts without words share their first place with the next text
            keep = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.window(key_words)[place].view(np.int64)), batch["doc_id"].take(keep), batch["_h"].take(keep),
                 pa.array((place - words.first[doc]).astype(np.int32))],
                names=["key", "doc_id", "_h", "at"],
            )

    kept = written(arrow_map(base, suffixes, f"key long, doc_id {id_type}, _h long, at int"), "suffixes")
    twice = _neighbours(kept, ["key"], ["doc_id", "_h", "at"], True, "matches")
    drop_written(kept)
    marked = twice.groupBy("doc_id", "_h").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    marked = marked.withColumnsRenamed({"doc_id": "_d", "_h": "_g"})
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g"))
    suspects = base.join(marked, on).select("doc_id", "_h", "ats", "text")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = Words([(t or "").encode() for t in batch["text"].to_pylist()], LANES)
            starts, place = words.anchors(passage)
            marks = np.zeros(len(words.hash), bool)
            for first, ats in zip(words.first, batch["ats"], strict=True):
                marks[first + np.asarray(ats.values)] = True
            starts = starts[marks[place]]
            doc = np.searchsorted(words.first, starts, side="right") - 1
            keep = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(words.window(passage, k)[starts].view(np.int64)) for k in range(LANES)), batch["doc_id"].take(keep),
                 batch["_h"].take(keep), pa.array((starts - words.first[doc]).astype(np.int32))],
                names=[*keys, "doc_id", "_h", "at"],
            )

    keys = [f"key{k}" for k in range(LANES)]
    schema = ", ".join(f"{k} long" for k in keys) + f", doc_id {id_type}, _h long, at int"
    extended = written(arrow_map(suspects, passages, schema), "passages")
    found = _neighbours(extended, keys, ["doc_id", "_h", "at"], False, "repeats")
    drop_written(twice)
    drop_written(extended)
    return found


def _cut(text: bytes, ats: np.ndarray, passage: int) -> tuple[bytes, list[dict], int]:
    """Text without the words of the passages at ``ats``, their word spans, and the word count."""
    words = Words([text])
    n = len(words.start)
    gone = np.zeros(n + 1, np.int32)
    np.add.at(gone, ats, 1)
    np.add.at(gone, np.minimum(ats + passage, n), -1)
    off = np.cumsum(gone)[:n] > 0
    edge = np.diff(np.concatenate([[False], off, [False]]).astype(np.int8))
    spans = list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words.start[a]])
        at = int(words.start[b]) if b < n else len(text)
    out.append(text[at:])
    return b"".join(out), [{"from": a, "to": b} for a, b in spans], n


def remove_repeats(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """``docs`` with passages of ``passage`` words or more cut out of ``text`` wherever they have an earlier place.

    Every row and column stays; ``_spans`` (word spans cut) and ``_words`` (count before) are added.
    n_chars, where there is such a long column, follows the text. Passages are equal where two independent
    64-bit hashes of their words are. Defined cases: null and short texts stay as they are; a text must
    fit in a worker, with about 20 bytes of memory a byte; rows of equal id and text are one place, so all of them keep it; null ids come
    first; a text may end up empty; an empty table gives none.
    """
    outer, (docs, inner) = docs, shielded(docs)
    tag = _tag(docs)
    places = repeated_places(docs.select("doc_id", "text", tag.alias("_h")), passage).groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_g"))
    places = places.agg(F.collect_list("at").alias("_ats"))
    joined = docs.join(places, docs["doc_id"].eqNullSafe(F.col("_d")) & (tag == F.col("_g")), "left").drop("_d", "_g")
    fields = docs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    count = any(f.name == "n_chars" and f.dataType.simpleString() == "bigint" for f in fields)
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            texts, spans, sizes, chars = [], [], [], batch["n_chars"].to_pylist() if count else None
            for k, (text, ats) in enumerate(zip(batch["text"].to_pylist(), batch["_ats"], strict=True)):
                if ats.is_valid and text is not None:
                    cut, gone, n = _cut(text.encode(), np.unique(np.asarray(ats.values)), passage)
                    text = cut.decode()
                    if count:
                        chars[k] = len(text)
                else:
                    gone, n = [], len((text or "").encode().split())
                texts.append(text)
                spans.append(gone)
                sizes.append(n)
            cols = {c: batch[c] for c in batch.schema.names if c != "_ats"}
            cols["text"] = pa.array(texts, pa.string())
            if count:
                cols["n_chars"] = pa.array(chars, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*cols.values(), pa.array(spans, span), pa.array(sizes, pa.int64())], names=[*cols, "_spans", "_words"]
            )

    cut = arrow_map(joined, run, f"{schema}, _spans array<struct<`from`:int,`to`:int>>, _words long")
    return restored(cut, outer, inner, "_spans", "_words")
