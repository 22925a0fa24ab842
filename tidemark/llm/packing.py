"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction.

Sizes are whole numbers up to the capacity, so an instance of any size is a histogram of as many
counts as a sequence has tokens, and so is its plan: what holds for one piece of a size holds for all.

Reduction: a sequence that holds a piece may be fixed for good where some set of at most two partners
dominates every other set that could go with the piece, that is, where each other set can be split into
parts no larger than a partner of their own. Fixing is repeated on the shrunken instance until nothing
dominates; then the remaining sizes are placed by best fit, the largest first. Every step takes as many
equal pieces or sequences at once as there are, so the plan has few entries, whatever the table's size.

Pieces get their place in it by their number among the pieces of their size, which is counted in the
task that makes them and moved by the counts of the tasks before; no size has to meet in one task.
"""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import _gather
from tidemark.llm.common import arrow_map, columns_of, text_slices, written

CAPACITY, END_ID = 1024, 2
BATCH_BYTES = 4 << 20
#: Pieces of text whose ids a Python worker remembers, across its tasks.
REMEMBERED = 1_200_000
#: Chunks that one call gives to the library, and the letter that stands for a blank in its tokens.
LINE_CHUNKS, BLANK = 2048, "Ġ"
#: Marks before which a chunk may end after an ASCII letter or digit.
MARKS = b".,;:!?"
#: Letters beyond ASCII that are white space: texts that hold one are given to the library whole.
_SPACES = r"[\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkedBPE:
    """A byte-level BPE of the tokenizers library, asked once for each distinct chunk.

    Its words take one blank before them and no other, and letters and marks are different words; so a
    text may be cut wherever ASCII white space begins, as long as no other white space stands before it,
    and between an ASCII letter or digit and a mark. Texts that hold special tokens or rarer white space
    are given to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = "|".join([_SPACES, *("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in special)])
        names = self.library.get_vocab()
        self.blank_first = np.zeros(max(names.values()) + 1, bool)
        self.blank_first[[i for t, i in names.items() if t.startswith(BLANK)]] = True
        self._forget()

    def _forget(self) -> None:
        self.names = pa.array([], pa.string())
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _known(self, chunks: pa.StringArray) -> np.ndarray:
        """The number of each of the different ``chunks`` in the memory; new ones are encoded."""
        if len(self.names) > REMEMBERED:
            self._forget()
        at = np.asarray(pc.fill_null(pc.index_in(chunks, value_set=self.names), -1)).astype(np.int64)
        fresh = np.nonzero(at < 0)[0]
        new = chunks.take(pa.array(fresh))
        usual = pc.match_substring_regex(new, r"^ [^\x09-\x0d ]")
        for part, encode in ((new.filter(usual), self._lines), (new.filter(pc.invert(usual)), self._singly)):
            ids, sizes = encode(part)
            self.names = pa.concat_arrays([self.names, part])
            self.flat = np.concatenate([self.flat, ids])
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64))
        usual = usual.to_numpy(zero_copy_only=False)
        base = len(self.names) - len(new)
        at[fresh[usual]] = base + np.arange(usual.sum())
        at[fresh[~usual]] = base + usual.sum() + np.arange((~usual).sum())
        return at

    def _singly(self, chunks: pa.StringArray) -> tuple[np.ndarray, list[int]]:
        each = [e.ids for e in self.library.encode_batch_fast(chunks.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *(np.array(e, np.int32) for e in each)]), [len(e) for e in each]

    def _lines(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray | list[int]]:
        """Chunks of a blank and a word, many in one text: a token that begins with a blank begins a chunk."""
        at = np.append(np.arange(0, len(chunks), LINE_CHUNKS), len(chunks)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), chunks), "").to_pylist() if len(chunks) else []
        got = self.library.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in got)])
        first = np.nonzero(self.blank_first[ids])[0]
        if len(first) != len(chunks) or len(first) and first[0]:
            return self._singly(chunks)
        return ids, np.diff(np.append(first, len(ids)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each ends; null texts have none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        ids, ends = self._in_chunks(plain)
        if not odd.any():
            return ids, ends
        whole = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        parts = iter(np.split(ids, ends[:-1]) if len(ends) else [])
        rest = iter(whole)
        rows = [next(rest) if o else next(parts) for o in odd.tolist()]
        return np.concatenate(rows), np.cumsum([len(r) for r in rows])

    def _in_chunks(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at -= at[0]
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        before = np.append(np.uint8(32), raw[:-1])
        begins = (blank & ~np.append(False, blank[:-1])) | (_MARK[raw] & _ALNUM[before])
        begins[at[at < len(raw)]] = True
        start = np.nonzero(begins)[0]
        chunks = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(raw)).astype(np.int32)), pa.py_buffer(raw))
        coded = chunks.dictionary_encode()
        known = self._known(coded.dictionary)[np.asarray(coded.indices)]
        ids, ends = _gather(self.flat, self.starts[:-1], self.starts[1:], known)
        return ids, np.append(0, ends)[np.searchsorted(start, at[1:])]


_ALNUM, _MARK = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (string.ascii_letters.encode() + string.digits.encode(), MARKS))


@cache
def chunked(path: str) -> ChunkedBPE:
    return ChunkedBPE(path)


@dataclass
class Kind:
    """Sequences that are filled alike: how many, what they have left, and the runs of pieces they hold (size, first, each)."""

    copies: int
    left: int
    held: list[tuple[int, int, int]] = field(default_factory=list)

    def parted(self, n: int) -> tuple[Kind, Kind]:
        """The first ``n`` copies and the others."""
        return Kind(n, self.left, list(self.held)), Kind(self.copies - n, self.left, [(s, a + n * q, q) for s, a, q in self.held])


class Plan:
    """Packing of a histogram of sizes: ``counts[size]`` pieces of each."""

    def __init__(self, counts: list[int], capacity: int) -> None:
        self.capacity = capacity
        self.left = list(counts)  # of each size, pieces without a sequence
        self.used = [0] * len(counts)
        self.sizes = [s for s, n in enumerate(counts) if n]
        self.closed: list[Kind] = []
        self.fixed = 0

    def _take(self, size: int, n: int) -> int:
        """The number of the first of ``n`` pieces that are taken."""
        first = self.used[size]
        self.used[size] += n
        self.left[size] -= n
        if not self.left[size]:
            self.sizes.pop(bisect_left(self.sizes, size))
        return first

    def _partner(self, room: int, *gone: int) -> int:
        """The largest size that fits into ``room`` and is there beside the pieces ``gone``; 0 if none is."""
        k = bisect_left(self.sizes, room + 1) - 1
        while k >= 0 and self.left[self.sizes[k]] <= gone.count(self.sizes[k]):
            k -= 1
        return self.sizes[k] if k >= 0 else 0

    def _smallest(self, n: int, *gone: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - gone.count(s))
            if len(out) == n:
                break
        return out

    def dominating(self, size: int) -> tuple[int, ...] | None:
        """Partners of a piece that dominate every other set that fits with it; null where none of two or fewer is known to."""
        room = self.capacity - size
        best = self._partner(room, size)
        if not best:
            return ()
        few = self._smallest(3, size)
        if best == room or len(few) < 2 or few[0] + few[1] > room:
            return (best,)  # it fills the sequence, or nothing else can join one partner
        if len(few) == 3 and sum(few) <= room:
            return None
        # at most two partners: sets are one piece, or x >= y
        pair = widest = 0
        for y in self.sizes:
            x = self._partner(room - y, size, y)
            if x < y:
                break
            pair, widest = max(pair, x + y), y
        if best >= pair:
            return (best,)
        second = self._partner(room - best, size, best)
        return (best, second) if second >= widest else None

    def reduce(self) -> None:
        """Fix dominating sets, the largest pieces first, until none is left."""
        again = True
        while again:
            again = False
            for size in reversed(list(self.sizes)):
                while self.left[size] and (with_ := self.dominating(size)) is not None:
                    held = [size, *with_]
                    n = min(self.left[s] // held.count(s) for s in held)
                    self._close(held, n)
                    again = True

    def _close(self, held: list[int], n: int) -> None:
        self.fixed += n
        runs = [(s, self._take(s, n * held.count(s)), held.count(s)) for s in dict.fromkeys(held)]
        self.closed.append(Kind(n, self.capacity - sum(held), runs))

    def best_fit(self) -> None:
        """Place what is left, the largest first, each where it leaves the least."""
        open_: dict[int, list[Kind]] = {}
        rooms: list[int] = []

        def put(kind: Kind) -> None:
            if not kind.copies:
                return
            if kind.left not in open_:
                insort(rooms, kind.left)
            open_.setdefault(kind.left, []).append(kind)

        for size in reversed(list(self.sizes)):
            while self.left[size]:
                k = bisect_left(rooms, size)
                if k < len(rooms):
                    room = rooms[k]
                    kind = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(k)
                else:
                    room, kind = self.capacity, Kind(self.left[size], self.capacity)
                # a sequence that has taken one piece is the fullest that takes another
                each = min(room // size, self.left[size])
                n = min(kind.copies, self.left[size] // each)
                taken, rest = kind.parted(n)
                taken.held.append((size, self._take(size, n * each), each))
                taken.left -= each * size
                put(taken)
                if rest.held:
                    put(rest)
        self.closed += [kind for kinds in open_.values() for kind in kinds]

    def entries(self) -> np.ndarray:
        """(size, first, last + 1, each, sequence, offset) of every run of equal pieces, by size and first.

        Piece i of a size is the ((i - first) mod each)-th from ``offset`` on of the sequence ``sequence`` + (i - first) / each.
        """
        out, base = [], 0
        for kind in self.closed:
            offset = 0
            for size, first, each in kind.held:
                out.append((size, first, first + each * kind.copies, each, base, offset))
                offset += each * size
            base += kind.copies
        return np.array(sorted(out), np.int64).reshape(-1, 6)

    @property
    def sequences(self) -> int:
        return sum(k.copies for k in self.closed)


def planned(counts: list[int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): encoded documents in pieces; nth counts pieces of a length in their task."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bpe, seen = chunked(path), np.zeros(capacity + 1, np.int64)
        for batch in text_slices(batches, "text", BATCH_BYTES):
            ids, ends = bpe.encode(batch["text"])
            n = np.diff(ends, prepend=0)
            ids = np.insert(ids, ends, END_ID)
            n = n + 1
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = n - (pieces - 1) * capacity  # the first piece is the short one
            length = np.where(piece == 0, head[doc], capacity)
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            to = np.cumsum(length)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((to - length).tolist(), to.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            many = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(many) - many, many)
            nth += seen[length]
            seen += many
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                 pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    rows = columns_of(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (written: part and nth must not change) with sequence_id and offset.

    The driver sees one count a length, and tasks get the plan: a few thousand entries, bounded by the capacity alone.
    """
    many = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = [0] * (capacity + 1)
    for r in many.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    table = planned(counts, capacity).entries()
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = many.select("length", "part", before.alias("before"))
    numbered = pieces.join(based, ["length", "part"]).withColumn("nth", F.col("before") + F.col("nth")).drop("before", "part")
    names = [c for c in numbered.columns if c != "nth"]
    fields = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, nth = np.asarray(batch["length"]), np.asarray(batch["nth"])
            row = np.zeros(len(length), np.int64)
            for s in np.unique(length).tolist():
                on = length == s
                own = table[first[s] : first[s + 1], 1]
                row[on] = first[s] + np.searchsorted(own, nth[on], side="right") - 1
            _, start, _, each, base, offset = table[row].T
            k = nth - start
            cols = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(base + k // each), pa.array(offset + k % each * length)], names=[*names, "sequence_id", "offset"])

    return arrow_map(numbered, run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document, with its end id, in sequences of at most ``capacity`` tokens.

    Defined cases: null and empty texts are the end id alone; a document that fits is one piece, a longer one is
    cut so that all pieces but the first are full; rows of one id, null ones too, are documents of their own; a
    text must fit in a worker; an empty table gives no rows; other columns are ignored, also where a name differs
    in case only.
    """
    return place(written(cut_pieces(docs, capacity, path), "pieces"), capacity)
