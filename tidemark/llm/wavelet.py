"""Token ids as one succinct, compressed wavelet-matrix file per shard.

A wavelet matrix keeps the bits of the ids, highest first, as planes; below each plane the ids are
stably parted into zeros and ones. Rank on the planes gives token access, counting of a token in a
prefix and the place of its k-th occurrence without unpacking the file. Planes are cut into blocks
that are compressed singly, with a rank directory, so a lookup touches one block a plane.

File: magic, header (json, length first), document ids, ends of documents, then per plane the
cumulative ones and offsets of its blocks, and the blocks.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import PairIndexBPE, WordIds, default_path
from tidemark.llm.common import arrow_map, columns_of, new_path, text_slices, written

MAGIC = b"TMWM\x01\n"
#: Bits of a plane's block.
BLOCK_BITS = 1 << 16
#: Unpacked blocks that an open shard keeps.
KEPT_BLOCKS = 256
#: Tokens after which a shard is closed, at the end of a document.
SHARD_TOKENS = 2 << 20
END_ID = 1
#: Words that one call gives to the tokenizers library.
LINE_WORDS = 2048
BATCH_BYTES = 4 << 20


class LibraryBPE(PairIndexBPE):
    """The same words, encoded by the tokenizers library. A word's last id is one that ends words."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ends_word = np.array([t.endswith(self.end) for t in self.token.to_pylist()])

    def merge_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        at = np.append(np.arange(0, len(words), LINE_WORDS), len(words)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), words), " ").to_pylist()
        got = self.library.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in got)])
        starts = np.append(0, np.nonzero(self.ends_word[ids])[0] + 1)
        if len(starts) != len(words) + 1 or starts[-1] != len(ids):
            each = [e.ids for e in self.library.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
            ids = np.array([i for e in each for i in e], np.int32)
            starts = np.append(0, np.cumsum([len(e) for e in each]))
        return ids, starts


@cache
def library(path: str) -> tuple[LibraryBPE, WordIds]:
    return LibraryBPE(path), WordIds()


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """The file of a shard: ids of all its documents, one after the other."""
    levels = max(1, int(ids.max(initial=0)).bit_length())
    cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1)
    zeros, tables, body = [], [], []
    for level in range(levels - 1, -1, -1):
        mask = (cur & cur.dtype.type(1 << level)) != 0
        bits = np.packbits(mask, bitorder="little")
        raw = bits.tobytes()
        cuts = range(0, len(raw), BLOCK_BITS // 8)
        blocks = [squeeze.compress(raw[c : c + BLOCK_BITS // 8]) for c in cuts]
        ones = np.array([np.bitwise_count(bits[c : c + BLOCK_BITS // 8]).sum(dtype=np.uint64) for c in cuts], np.uint64)
        tables.append(np.append(np.uint64(0), np.cumsum(ones, dtype=np.uint64)).tobytes())
        tables.append(np.append(0, np.cumsum([len(b) for b in blocks])).astype("<u8").tobytes())
        body += blocks
        off = ~mask
        zeros.append(int(np.count_nonzero(off)))
        cur = np.concatenate([cur[off], cur[mask]])  # a stable parting
    head = {"n": len(ids), "levels": levels, "zeros": zeros, "docs": len(doc_ids), "null_ids": [k for k, d in enumerate(doc_ids) if d is None]}
    said = json.dumps(head).encode()
    named = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    return b"".join([MAGIC, struct.pack("<I", len(said)), said, named, ends.astype("<u8").tobytes(), *tables, *body])


class WaveletMatrix:
    """Lookups in one packed shard; blocks are unpacked when they are touched."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack_from("<I", data, len(MAGIC))[0]
        at = len(MAGIC) + 4
        head = json.loads(data[at : at + size])
        at += size
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        self.doc_ids: list[int | None] = np.frombuffer(data, "<i8", head["docs"], at).tolist()
        for k in head["null_ids"]:
            self.doc_ids[k] = None
        at += 8 * head["docs"]
        self.ends = np.frombuffer(data, "<u8", head["docs"], at).astype(np.int64)
        at += 8 * head["docs"]
        blocks = -(-self.n // BLOCK_BITS)
        self._ones, self._offsets = [], []
        for _ in range(self.levels):
            self._ones.append(np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64))
            self._offsets.append(np.frombuffer(data, "<u8", blocks + 1, at + 8 * (blocks + 1)).astype(np.int64))
            at += 16 * (blocks + 1)
        self._data, self._body = data, []
        for offsets in self._offsets:
            self._body.append(at)
            at += int(offsets[-1])
        self._seen: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def _block(self, plane: int, block: int) -> np.ndarray:
        """``_unpack``, with the last ``KEPT_BLOCKS`` results kept; they go with the shard."""
        at = (plane, block)
        if at not in self._seen:
            self._seen[at] = self._unpack(plane, block)
            if len(self._seen) > KEPT_BLOCKS:
                self._seen.popitem(last=False)
        self._seen.move_to_end(at)
        return self._seen[at]

    def _unpack(self, plane: int, block: int) -> np.ndarray:
        """Bits of one block as 0 and 1."""
        a, b = self._offsets[plane][block : block + 2]
        raw = zstandard.ZstdDecompressor().decompress(self._data[self._body[plane] + a : self._body[plane] + b], max_output_size=BLOCK_BITS // 8)
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.n - block * BLOCK_BITS]

    def _rank1(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK_BITS)
        return int(self._ones[plane][block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """The i-th token."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.levels):
            bit = int(self._block(plane, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._rank1(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """First place of ``token`` below the last plane, and the end of those of its first i tokens."""
        lo, hi = 0, i
        if token >> self.levels:
            return 0, 0
        for plane in range(self.levels):
            if token >> (self.levels - 1 - plane) & 1:
                lo, hi = (self.zeros[plane] + self._rank1(plane, k) for k in (lo, hi))
            else:
                lo, hi = (k - self._rank1(plane, k) for k in (lo, hi))
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How many of the first i tokens are ``token``."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ones = self._ones[plane]
        sums = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        block = int(np.searchsorted(sums, k, side="right")) - 1
        return block * BLOCK_BITS + int(np.nonzero(self._block(plane, block) == bit)[0][k - int(sums[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of ``token``."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for plane in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all_ids(self) -> np.ndarray:
        """Every token, by undoing the partings from the last plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        blocks = len(self._ones[0]) - 1 if self.levels else 0
        for plane in range(self.levels - 1, -1, -1):
            bits = [self._unpack(plane, b) for b in range(blocks)]
            mask = np.concatenate(bits).view(bool) if bits else np.zeros(0, bool)
            out = np.empty(self.n, kind)
            out[~mask] = cur[: self.zeros[plane]]
            cur[self.zeros[plane] :] |= kind(1 << (self.levels - 1 - plane))
            out[mask] = cur[self.zeros[plane] :]
            cur = out
        return cur.astype(np.int32)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def write_shards(docs: DataFrame, folder: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text, append the end id, write shards in ascending doc_id order; the manifest of what was written.

    Tasks are key ranges of doc_id, so shards ordered by (part, seq) are in order. A shard is
    written under a name of its own attempt and appears by a rename; only the manifest names
    files that count, so a lost executor leaves at most files that nothing reads.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        bpe, memory = library(path)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        seq = held = 0

        def flush() -> pa.RecordBatch:
            lengths = np.concatenate(sizes)
            data = pack(np.concatenate(ids), names, np.cumsum(lengths))
            name = f"shard-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wm"
            with store.open_output_stream(f"{base}/_{name}") as out:
                out.write(data)
            store.move(f"{base}/_{name}", f"{base}/{name}")
            row = {"part": [part], "seq": [seq], "file": [f"{folder}/{name}"], "n_docs": [len(names)], "n_tokens": [int(lengths.sum())]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in text_slices(batches, "text", BATCH_BYTES):
            coded = bpe.encode(batch["text"], memory)
            ends = np.asarray(coded.offsets).astype(np.int64)[1:]
            size = np.diff(np.append(0, ends))
            ids.append(np.insert(np.asarray(coded.values), ends, END_ID))
            sizes.append(size + 1)
            names += batch["doc_id"].to_pylist()
            held += len(ids[-1])
            if held >= shard_tokens:
                yield flush()
                ids, names, sizes, held, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    rows = columns_of(docs, "doc_id", "text").withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")
    return written(arrow_map(rows, run, "part int, seq int, file string, n_docs long, n_tokens long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files alone."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    placed = manifest.select("part", "seq", "file", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                store, at = _store(file)
                with store.open_input_file(at) as f:
                    shard = WaveletMatrix(f.read())
                raw = memoryview(shard.all_ids().astype("<u4", copy=False)).cast("B")
                ends = shard.ends.tolist()
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                cols = [
                    pa.array(shard.doc_ids, pa.int64()), pa.array([base + a for a in starts], pa.int64()),
                    pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each shard: left alone, adaptive execution would gather the short manifest into one
    return arrow_map(placed.repartition(max(1, manifest.count())), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards of ``docs`` in a new folder of the shared one, read back to a row per document.

    Defined cases: null and blank texts are the end id alone; null ids come first; rows of one id
    stand by the hash of their texts; repeated rows are repeated; a text of any length stays in one
    shard; other columns are ignored, also where a name differs in case only; an empty table writes
    nothing and gives no rows.
    """
    folder = new_path(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, folder, path, shard_tokens))
