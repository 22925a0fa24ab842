"""BPE encoding through a pair occurrence index, and decoding.

All distinct words of a partition's batch lie in one symbol array. An index maps each mergeable
pair to every position at which it occurs. Ranks that are active are applied in ascending order,
each to all its positions at once, and the lists of the pairs that a merge makes are extended.
The vocabulary is a public tokenizer file whose path is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_map, columns_of, restored, shielded, text_slices

#: Text of one index; larger batches share more words.
BATCH_BYTES = 4 << 20
#: Words whose ids a Python worker remembers, across its tasks.
REMEMBERED = 400_000
#: Marks that often end a word, and runs that are one word of letters whose lower case is one letter each, perhaps with such a mark.
PLAIN_ENDS = ".,;:!?"
PLAIN = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{PLAIN_ENDS}]?$"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next free one from 256."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def _folded(text: str) -> str:
    """NFC, then lower case letter by letter: a final sigma has no form of its own here."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def _unassigned(text: str) -> set[str]:
    """Characters that Python's tables don't know; the regex module and the tokenizers library have newer ones."""
    return set() if text.isascii() else {c for c in set(text) if unicodedata.category(c) == "Cn"}


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PairIndexBPE:
    """Encoder and decoder for a BPE vocabulary with word ends, lower case and white space dropped."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.special = special
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        self.last_id = np.array([vocab[c + self.end] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.left = (keys // self.size).astype(np.int32)
        self.right = (keys % self.size).astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        names = {i: t for t, i in chain(vocab.items(), special.items())}
        self.token = pa.array([names.get(i, "") for i in range(self.size)])
        self.digits = pa.array([str(i) for i in range(self.size)])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it never merges."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words, one after the other, and where each word's begin; the last entry is their count."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        _, offsets, data = words.buffers()
        bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        size, ends = np.diff(bounds), bounds[1:] - bounds[0]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        sym = self.byte_id[raw]
        sym[ends - 1] = self.last_id[raw[ends - 1]]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv[ends - size] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self._rank(sym[at], sym[nxt[at]])
            on = rank >= 0
            if not on.any():
                return
            at, rank = at[on], rank[on]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.nonzero(np.diff(rank))[0] + 1
            for r, part in zip(rank[np.append(0, cut)].tolist(), np.split(at, cut), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        add(np.nonzero(nxt >= 0)[0])
        while active:
            r = heapq.heappop(active)
            at = index.pop(r)
            at = at[0] if len(at) == 1 else np.concatenate(at)
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # of overlapping occurrences the left one merges
                at = np.unique(at)
                taken: set[int] = set()
                for p, q in zip(at.tolist(), nxt[at].tolist(), strict=True):
                    if p not in taken:
                        taken.add(q)
                at = at[[p not in taken for p in at.tolist()]]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone], nxt[at] = self.made[r], -1, after
            on = after >= 0
            prv[after[on]] = at[on]
            before = prv[at]
            add(np.concatenate([before[before >= 0], at[on]]))
        alive = np.nonzero(sym >= 0)[0]
        return sym[alive], np.searchsorted(alive, np.append(0, ends))

    def _pieces(self, chunk: str) -> list[str]:
        """Words and special tokens of a raw chunk that may hold special tokens; those are found before any folding."""
        out: list[str] = []
        for part in self.special_split.split(chunk) if self.special_split else [chunk]:
            if part in self.special:
                out.append(part)
            elif _unassigned(part):
                out += self._by_library(part)
            else:
                out += self.words.findall(_folded(part))
        return out

    def _by_library(self, part: str) -> list[str]:
        """Words of a text with letters newer than Python's character tables, as the tokenizers library sees them."""
        t = _library(self.path)
        part = t.normalizer.normalize_str(part)
        return [part[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(part)]

    def _words_of(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """The words of chunks of any kind, and how many each has. Chunks hold no ASCII white space, so folding them by lines is safe."""
        text = "\n".join(chunks)
        odd = self.special.keys() | _unassigned(text)
        odd = re.compile("|".join(map(re.escape, odd))) if any(o in text for o in odd) else None
        words: list[str] = []
        counts: list[int] = []
        for k, low in enumerate(_folded(text).split("\n")):
            part = self._pieces(chunks[k]) if odd and odd.search(chunks[k]) else self.words.findall(low)
            words += part
            counts.append(len(part))
        return words, counts[: len(chunks)]

    def _split(self, chunks: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all chunks, in order, and how many each has; plain chunks never become Python strings."""
        plain = pc.match_substring_regex(chunks, PLAIN)
        low = pc.utf8_lower(chunks.filter(plain))
        marked = pc.match_substring_regex(low, f"[{PLAIN_ENDS}]$")
        body, mark = pc.utf8_rtrim(low, characters=PLAIN_ENDS), pc.utf8_slice_codeunits(low.filter(marked), -1)
        odd, n_odd = self._words_of(chunks.filter(pc.invert(plain)).to_pylist())
        plain, marked = (m.to_numpy(zero_copy_only=False) for m in (plain, marked))
        counts = np.zeros(len(chunks), np.int64)
        counts[plain] = 1 + marked
        counts[~plain] = n_odd
        first = np.cumsum(counts) - counts
        order = np.empty(int(counts.sum()), np.int64)
        own = first[plain]
        order[own] = np.arange(len(body))
        order[own[marked] + 1] = len(body) + np.arange(len(mark))
        rest = counts[~plain]
        order[np.repeat(first[~plain] - (np.cumsum(rest) - rest), rest) + np.arange(rest.sum())] = len(body) + len(mark) + np.arange(len(odd))
        words = pa.concat_arrays([body, mark, pa.array(odd, pa.string())]).dictionary_encode()
        return pa.DictionaryArray.from_arrays(pa.array(np.asarray(words.indices)[order]), words.dictionary), counts

    def encode(self, texts: pa.Array, memory: WordIds | None = None) -> pa.ListArray:
        """Ids of each text; null and blank texts have none. ``memory`` keeps words across calls."""
        memory = WordIds() if memory is None else memory
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        words, counts = self._split(coded.dictionary)
        known = memory.lookup(words.dictionary, self)[np.asarray(words.indices)]
        part = np.append(0, np.cumsum(counts))
        chunk_words, chunk_ends = _gather(known, part[:-1], part[1:], np.asarray(coded.indices))
        ids, ends = _gather(memory.flat, memory.starts[:-1], memory.starts[1:], chunk_words)
        ends = np.append(0, ends)[np.append(0, chunk_ends)[np.asarray(lists.offsets) - lists.offsets[0].as_py()]]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens, special ones too, joined by blanks: the file names no decoder. Null ids give an empty text."""
        return _joined(ids, self.token)

    def decimal(self, ids: pa.ListArray) -> pa.Array:
        return _joined(ids, self.digits)


def _joined(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    parts = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), names.take(ids.values))
    return pc.fill_null(pc.binary_join(parts, " "), "")


def _gather(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[starts[k]:ends[k]] for each k of ``at``, end to end, and where each ends."""
    size = (ends - starts)[at]
    stop = np.cumsum(size)
    where = np.repeat(starts[at] - (stop - size), size)
    where += np.arange(len(where))
    return values[where], stop


class WordIds:
    """Ids of the words a worker has met, in one array beside the words."""

    def __init__(self) -> None:
        self.names = pa.array([], pa.string())
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def lookup(self, words: pa.StringArray, bpe: PairIndexBPE) -> np.ndarray:
        """Place of each of the different ``words``; new ones share one pair index."""
        if len(self.names) > REMEMBERED:
            self.__init__()
        at = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.names), -1)).astype(np.int64)
        fresh = np.nonzero(at < 0)[0]
        new = words.take(pa.array(fresh))
        named = pc.is_in(new, value_set=pa.array(list(bpe.special), pa.string()))
        plain, special = new.filter(pc.invert(named)), new.filter(named)
        ids, starts = bpe.merge_words(plain)
        own = np.array([bpe.special[w] for w in special.to_pylist()], np.int32)
        named = named.to_numpy(zero_copy_only=False)
        at[fresh[~named]] = len(self.names) + np.arange(len(plain))
        at[fresh[named]] = len(self.names) + len(plain) + np.arange(len(special))
        self.names = pa.concat_arrays([self.names, plain, special])
        base = self.starts[-1]
        self.starts = np.concatenate([self.starts, base + starts[1:], base + starts[-1] + np.arange(1, len(own) + 1)])
        self.flat = np.concatenate([self.flat, ids, own])
        return at


@cache
def load(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


@cache
def worker_memory(path: str) -> WordIds:
    return WordIds()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode_column(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``_ids`` array<int> added in front. Every column stays; a taken name gets more underscores.

    Defined cases: null and blank texts have an empty list; a text of any length is one list; repeated
    rows are encoded alike; an empty table gives no rows.
    """
    path = path or default_path()
    rows, inner = shielded(docs, (text,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memory = load(path), worker_memory(path)
        for batch in text_slices(batches, text, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([bpe.encode(batch[text], memory), *batch.columns], names=["_ids", *batch.schema.names])

    return restored(arrow_map(rows, run, f"_ids array<int>, {_schema(rows)}"), docs, inner, "_ids", front=True)


def decode_column(encoded: DataFrame, path: str | None = None, ids: str = "_ids") -> DataFrame:
    """``encoded`` with ``_decoded`` string added in front; null ids decode to an empty text. A taken name gets more underscores."""
    path = path or default_path()
    rows, inner = shielded(encoded, (ids,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([bpe.decode(batch[ids]), *batch.columns], names=["_decoded", *batch.schema.names])

    return restored(arrow_map(rows, run, f"_decoded string, {_schema(rows)}"), encoded, inner, "_decoded", front=True)


def coded_column(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``_ids`` array<int> and ``_decoded`` string in front: encoded and decoded by one worker.

    Defined cases as for ``encode_column``; a text without ids decodes to an empty one.
    """
    path = path or default_path()
    rows, inner = shielded(docs, (text,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memory = load(path), worker_memory(path)
        for batch in text_slices(batches, text, BATCH_BYTES):
            ids = bpe.encode(batch[text], memory)
            rest = {c: batch[c] for c in batch.schema.names if c != text}
            yield pa.RecordBatch.from_arrays([ids, bpe.decode(ids), *rest.values()], names=["_ids", "_decoded", *rest])

    out = arrow_map(rows, run, f"_ids array<int>, _decoded string, {_schema(rows.drop(text))}")
    kept = [(i, c) for i, c in zip(inner, docs.columns, strict=True) if i != text]
    return restored(out, [c for _, c in kept], [i for i, _ in kept], "_ids", "_decoded", front=True)


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded in one pass.

    Defined cases: null and blank texts have no ids, and both digests are those of an empty text;
    long texts are whole; repeated rows and null ids give a row each; other columns are ignored, also
    where a name differs in case only; an empty table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memory = load(path), worker_memory(path)
        for batch in text_slices(batches, "text", BATCH_BYTES):
            ids = bpe.encode(batch["text"], memory)
            hexes = [
                pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in side], pa.string())
                for side in (bpe.decimal(ids), bpe.decode(ids))
            ]
            n = pa.array(np.diff(np.asarray(ids.offsets)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], n, *hexes], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    rows = columns_of(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
