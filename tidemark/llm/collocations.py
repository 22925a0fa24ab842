"""Phrase collocations by vertical positional inverted lists.

Texts are indexed in blocks of one language: each word of a block has the list of the places where it
occurs, and the length of a phrase's lists, summed over the blocks, is its exact frequency. Phrases
grow by a word at a time: the places of a frequent phrase are merge-joined with the postings one
place on, and since every part of a frequent phrase is frequent, what stands in those postings is the
phrase that ends with the adjacent word. So a phrase of k words is known by the numbers of the two
frequent phrases of k - 1 words that it holds, exactly and without any hash.

Only words or numbers with their counts are shuffled by phrase, numbers packed by part; the lists stay with their block, to
which the numbers of its frequent phrases are joined, and only the lists of frequent phrases are kept.
A phrase that every text has is one row a block, and a task's texts of one language are as many blocks as they
fill. Before a block asks for numbers, a filter of the frequent phrases, as long as that is small,
spares the shuffle most of those that are not; the numbers themselves decide. Blocks ask for them, packed by part
of the phrases, and the answers go back packed by block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, columns_of, drop_written, scratch, text_slices, tidy_shuffles, written
from tidemark.llm.words import Runs, letters

#: Words of the longest phrase, and occurrences of a candidate.
LONGEST, LEAST = 4, 30
#: Hundredths of a phrase's occurrences that a longer one must have to replace it, and phrases reported for a language.
REPLACED, TOP = 80, 2000
#: Text of a block.
BLOCK_BYTES = 4 << 20
#: Blocks that a task fills at a time, one a language; beyond that the fullest is closed.
OPEN_BLOCKS = 8
#: Bytes that part words, and those that part pieces, which no phrase crosses.
BLANKS, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = letters(BLANKS + STOPS)
_STOP = ~letters(STOPS)
#: Frequent phrases of one length up to which a filter of them is sent to all tasks: 16 bytes each on the driver, 2 to 4 in a task.
FILTERED = 1 << 22
#: Pairs that a task holds before it sends them on, and blocks whose pairs, as many as they are, make a part of all pairs.
HELD, PART_BLOCKS = 1 << 22, 4
#: Parts of a language in which its best phrases are looked for first.
SALTS = 64


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Integers as planes of their bytes, low ones first: the high planes of small numbers take next to nothing."""
    out = []
    for x in arrays:
        x = x.astype("<i4" if abs(x).max(initial=0) < 1 << 31 else "<i8")
        body = zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())
        out.append(struct.pack("<BQQ", x.itemsize, len(x), len(body)) + body)
    return b"".join(out)


def _arrays(data: bytes) -> list[np.ndarray]:
    out, at, head = [], 0, struct.calcsize("<BQQ")
    while at < len(data):
        size, n, packed = struct.unpack_from("<BQQ", data, at)
        raw = zstandard.ZstdDecompressor().decompress(data[at + head : at + head + packed], max_output_size=size * n)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"<i{size}").ravel().astype(np.int64))
        at += head + packed
    return out


def _postings(places: np.ndarray, key: np.ndarray, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The lists of keys 0 to len(ids) - 1, whose ids ascend, and their lengths; places ascend and are kept as steps."""
    order = np.argsort(key, kind="stable")
    counts = np.bincount(key, minlength=len(ids))
    listed = places[order]
    step = np.diff(listed, prepend=0)
    first = (np.cumsum(counts) - counts)[counts > 0]
    step[first] = listed[first]
    return _squeezed(np.diff(ids, prepend=0), counts, step), counts


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths and places of the lists."""
    ids, counts, step = _arrays(data)
    total = np.cumsum(step)
    first = np.cumsum(counts) - counts
    on = counts > 0
    return np.cumsum(ids), counts, total - np.repeat(total[first[on]] - step[first[on]], counts[on])


def word_lists(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, lang, words, counts, lists): the postings of a block's words. A place is a word's number; each piece leaves one out."""

    one = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t) if t else v)

    def listed(block: int, lang: str, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        runs = Runs(texts, _KIND)
        if not len(runs.words):
            return
        stops = np.append(0, np.cumsum(_STOP[runs.low]))[runs.start]
        text = runs.text_of()
        cut = np.append(False, (stops[1:] != stops[:-1]) | (text[1:] != text[:-1]))
        places = np.arange(len(cut)) + np.cumsum(cut)
        coded = runs.words.dictionary_encode()
        lists, counts = _postings(places, np.asarray(coded.indices), np.arange(len(coded.dictionary)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([lang]), one(coded.dictionary, None), one(counts, pa.int64()), pa.array([lists])],
            names=["block", "lang", "words", "counts", "lists"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal block
            block += 1
            del size[lang]
            return listed(block - 1, lang, pa.concat_arrays(held.pop(lang)))

        for batch in text_slices(batches, "text", block_bytes):
            langs = batch["lang"].dictionary_encode()
            which = np.asarray(langs.indices)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch["text"].filter(pa.array(which == k))
                n = pc.sum(pc.binary_length(texts)).as_py() or 0
                if lang in held and size[lang] + n > block_bytes:
                    yield from closed(lang)
                held.setdefault(lang, []).append(texts)
                size[lang] = size.get(lang, 0) + n
            while sum(size.values()) > OPEN_BLOCKS * block_bytes:
                yield from closed(max(size, key=size.get))
        for lang in list(held):
            yield from closed(lang)

    rows = columns_of(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return arrow_map(rows, run, "block long, lang string, words array<string>, counts array<long>, lists binary")


def _occurrences(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's lists: the ids, and where, in order of the places, which of them (by number) occurs."""
    ids, counts, places = _unpacked(row["lists"][0].as_py())
    of = np.repeat(np.arange(len(ids)), counts)
    order = np.argsort(places)
    return ids, places[order], of[order]


def _extended(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at which a phrase a word longer occurs, and what it is: first phrase times number of ids, plus second phrase."""
    ids, places, of = _occurrences(row)
    # an occurrence and one that begins a place later are one occurrence of a phrase a word longer
    met = np.nonzero(places[1:] == places[:-1] + 1)[0]
    return ids, places[met], of[met] * len(ids) + of[met + 1]


LISTS = "block long, lists binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1)


def _kept(block: pa.Array, places: np.ndarray, key: np.ndarray, n: int, found: bytes) -> pa.RecordBatch:
    """Lists of those of ``n`` keys that ``found`` has numbers for; places ascend."""
    at, ids = map(np.cumsum, _arrays(found))
    order = np.argsort(ids)
    number = np.full(n, -1, np.int64)
    number[at[order]] = np.arange(len(at))
    of = number[key]
    on = of >= 0
    return pa.RecordBatch.from_arrays([block, pa.array([_postings(places[on], of[on], ids[order])[0]])], names=["block", "lists"])


def first_lists(blocks: DataFrame) -> DataFrame:
    """Lists of a block's frequent words from those of all its words, with the numbers of the frequent ones in ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, places, of = _occurrences(row)
            yield _kept(row["block"], places, of, len(ids), row["found"][0].as_py())

    return arrow_map(blocks, run, LISTS)


def _summed(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, in order, with the sums of their counts."""
    order = np.lexsort((second, first))
    first, second, n = first[order], second[order], n[order]
    at = np.nonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))[0]
    return first[at], second[at], np.add.reduceat(n, at)


def _part_of(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    """Part of a pair: neighbours keep together, as their steps are short, but the pairs of one common word do not."""
    with np.errstate(over="ignore"):
        z = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (second >> 8).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((z >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _by_part(part: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Parts, and what belongs to each as steps of the columns, in the order given."""
    order = np.argsort(part, kind="stable")
    names, starts = np.unique(part[order], return_index=True)
    return names, [_squeezed(*(np.diff(x[on], prepend=0) for x in columns)) for on in np.split(order, starts[1:])]


def pair_counts(lists: DataFrame, parts: int) -> DataFrame:
    """(part, pairs): first, second and count of each phrase that is a word longer than a block's, packed by part, each pair in one part."""

    def packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        first, second, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        part = _part_of(first, second, parts)
        order = np.argsort(part, kind="stable")
        names, starts = np.unique(part[order], return_index=True)
        step = lambda x: np.diff(x, prepend=0)
        bodies = [_squeezed(step(first[at]), step(second[at]), n[at]) for at in np.split(order, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in _rows(batches):
            ids, _, key = _extended(row)
            pairs, n = np.unique(key, return_counts=True)
            if len(pairs):
                held.append((ids[pairs // len(ids)], ids[pairs % len(ids)], n))
                size += len(pairs)
            if size > HELD:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return arrow_map(lists, run, "part int, pairs binary")


def _parts(lists: DataFrame) -> int:
    return max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), lists.count() // PART_BLOCKS)


def frequent_pairs(lists: DataFrame, least: int) -> DataFrame:
    """(first, second, f) of the phrases a word longer than those of ``lists`` that occur ``least`` times or more."""
    parts = _parts(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def told() -> pa.RecordBatch:
            first, second, n = ([np.cumsum(x[0]) for x in held], [np.cumsum(x[1]) for x in held], [x[2] for x in held])
            first, second, f = _summed(*map(np.concatenate, (first, second, n)))
            on = f >= least
            return pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (first, second, f)], names=["first", "second", "f"])

        for row in _rows(batches):
            part = row["part"][0].as_py()
            if part != now and held:
                yield told()
                held = []
            now = part
            held.append(_arrays(row["pairs"][0].as_py()))
        if held:
            yield told()

    dealt = pair_counts(lists, parts).repartition(parts, "part").sortWithinPartitions("part")
    return arrow_map(dealt, run, "first long, second long, f long")


def _spots(first: np.ndarray, second: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of a pair in a filter of 2**bits bits."""
    with np.errstate(over="ignore"):
        z = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (second.astype(np.uint64) + np.uint64(0xD1342543DE82EF95)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return [(z >> np.uint64(64 - bits)).astype(np.int64), *((z >> np.uint64(s)).astype(np.int64) & ((1 << bits) - 1) for s in (3, 17))]


def pair_filter(frequent: DataFrame, most: int = FILTERED) -> np.ndarray | None:
    """Bits, eight a byte, that are all on for a frequent pair and seldom for another; null where there are more than ``most``.

    The driver sees the numbers of at most ``most`` pairs; tasks get 16 to 32 bits for each.
    """
    n = frequent.count()
    if not 0 < n <= most:
        return None
    bits = max(16, int(16 * n - 1).bit_length())
    out = np.zeros(1 << bits, bool)
    pairs = frequent.select("first", "second").toArrow()
    for at in _spots(pairs["first"].to_numpy(), pairs["second"].to_numpy(), bits):
        out[at] = True
    return np.packbits(out, bitorder="little")


def asked_pairs(lists: DataFrame, allowed: np.ndarray | None, parts: int) -> DataFrame:
    """(part, asked): block, at, first and second of the phrases that ``pair_counts`` packs and the filter does not rule out, packed by part.

    at is the phrase's place among those of the block, in order.
    """
    on = None if allowed is None else lists.sparkSession.sparkContext.broadcast(allowed)

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        block, at, first, second = (np.concatenate(x) for x in zip(*held, strict=True))
        names, bodies = _by_part(_part_of(first, second, parts), block, at, first, second)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in _rows(batches):
            ids, _, key = _extended(row)
            pairs = np.unique(key)
            at, first, second = np.arange(len(pairs)), ids[pairs // len(ids)], ids[pairs % len(ids)]
            if on is not None:
                table = on.value
                keep = np.logical_and.reduce([table[x >> 3] >> (x & 7).astype(np.uint8) & 1 for x in _spots(first, second, len(table).bit_length() + 2)]) == 1
                at, first, second = at[keep], first[keep], second[keep]
            if len(at):
                held.append((np.full(len(at), row["block"][0].as_py(), np.int64), at, first, second))
                size += len(at)
            if size > HELD:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return arrow_map(lists, run, "part int, asked binary")


def _by_block(block: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((at, block))
    return block[order], at[order], ids[order]


def _dealt(numbers: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, numbers) of blocks, places and ids: packed by part, all of a block in one part."""

    def packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        block, at, ids = _by_block(*(np.concatenate(x) for x in zip(*held, strict=True)))
        names, bodies = _by_part(_part_of(block, np.zeros_like(block), parts), block, at, ids)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "numbers"])

    held, size = [], 0
    for some in numbers:
        if len(some[0]):
            held.append(some)
            size += len(some[0])
        if size > HELD:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


DEALT = "part int, numbers binary"


def packed_numbers(numbers: DataFrame, parts: int) -> DataFrame:
    """The numbers (block, at, id) packed by part; all of a block are in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt((tuple(np.asarray(batch[c]) for c in ("block", "at", "id")) for batch in batches), parts)

    return arrow_map(numbers.select("block", "at", "id"), run, DEALT)


def pair_numbers(lists: DataFrame, frequent: DataFrame, most: int = FILTERED) -> DataFrame:
    """As ``packed_numbers``, the numbers of the frequent pairs (first, second, id) for the blocks of ``lists`` that hold them."""
    parts, back = _parts(lists), int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, second, ids = (np.asarray(batch[c]) for c in ("first", "second", "id"))
                names, bodies = _by_part(_part_of(first, second, parts), first, second, ids)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "pairs"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        now, told, known = None, [], None
        for row in _rows(batches):
            part, pairs, asked = (row[c][0].as_py() for c in ("part", "pairs", "asked"))
            if part != now:
                now, told, known = part, [], None
            if pairs is not None:  # those of a part come before what is asked of it
                told.append([np.cumsum(x) for x in _arrays(pairs)])
                continue
            if not told:
                continue
            if known is None:
                first, second, ids = (np.concatenate(x) for x in zip(*told, strict=True))
                firsts, seconds = np.unique(first), np.unique(second)
                code = np.searchsorted(firsts, first) * len(seconds) + np.searchsorted(seconds, second)
                order = np.argsort(code)
                known = firsts, seconds, code[order], ids[order]
            firsts, seconds, code, ids = known
            block, at, first, second = (np.cumsum(x) for x in _arrays(asked))
            i = np.minimum(np.searchsorted(firsts, first), len(firsts) - 1)
            j = np.minimum(np.searchsorted(seconds, second), len(seconds) - 1)
            want = i * len(seconds) + j
            k = np.minimum(np.searchsorted(code, want), len(code) - 1)
            hit = (firsts[i] == first) & (seconds[j] == second) & (code[k] == want)
            yield block[hit], at[hit], ids[k[hit]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(answers(batches), back)

    none = F.lit(None).cast("binary")
    told = arrow_map(frequent.select("first", "second", "id"), pack, "part int, pairs binary").withColumn("asked", none)
    asked = asked_pairs(lists, pair_filter(frequent, most), parts).withColumn("pairs", none)
    dealt = told.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", F.col("pairs").isNull())
    return arrow_map(dealt, run, DEALT)


def found_by_block(packed: DataFrame) -> DataFrame:
    """(block, found): the numbers of a block's phrases, from those packed by part, as steps of at and id."""
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def told(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        block, at, ids = _by_block(*map(np.concatenate, zip(*([np.cumsum(x) for x in steps] for steps in held), strict=True)))
        starts = np.nonzero(np.append(True, block[1:] != block[:-1]))[0]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True):
            found = _squeezed(*(np.diff(x[a:b], prepend=0) for x in (at, ids)))
            yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 1]), pa.array([found], pa.binary())], names=["block", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for row in _rows(batches):
            part = row["part"][0].as_py()
            if part != now and held:
                yield from told(held)
                held = []
            now = part
            held.append(_arrays(row["numbers"][0].as_py()))
        if held:
            yield from told(held)

    return arrow_map(packed.repartition(parts, "part").sortWithinPartitions("part"), run, "block long, found binary")


def longer_lists(lists: DataFrame) -> DataFrame:
    """Lists of the frequent phrases that are a word longer; ``found`` has the numbers of those of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, places, key = _extended(row)
            pairs, of = np.unique(key, return_inverse=True)
            yield _kept(row["block"], places, of, len(pairs), row["found"][0].as_py())

    return arrow_map(lists, run, LISTS)


def _numbered(frequent: DataFrame, tag: str) -> DataFrame:
    return written(frequent.withColumn("id", F.monotonically_increasing_id()), tag)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """A table of phrases for each length from 1 on, and (lang, n), the words of each language.

    A phrase has id, lang, words, f, its parent phrases' ids (first, second: without its last and its first
    word) and the frequencies of what it begins with (pre) and ends with (suf), by length.
    """
    blocks = written(word_lists(docs, block_bytes), "lists0", "zstd")
    total = written(blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("block", "at", "lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    frequent = _numbered(each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrases1")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(found_by_block(packed_numbers(each.drop("n").join(frequent, ["lang", "word"]), parts)), "found1")
    lists = written(first_lists(blocks.select("block", "lists").join(found, "block")), "lists1")
    for used in (blocks, found):
        drop_written(used)
    one = F.array("f")
    none = F.lit(None).cast("long")
    levels = [frequent.select("id", "lang", F.array("word").alias("words"), "f", none.alias("first"), none.alias("second"), one.alias("pre"), one.alias("suf"))]
    for k in range(2, longest + 1):
        frequent = _numbered(frequent_pairs(lists, least), f"phrases{k}")
        a = levels[-1].select(F.col("id").alias("first"), "lang", F.col("words").alias("_a"), "pre")
        b = levels[-1].select(F.col("id").alias("second"), F.element_at("words", -1).alias("_b"), "suf")
        grown = frequent.join(a, "first").join(b, "second")
        f = F.array("f")
        grown = grown.select("id", "lang", F.concat("_a", F.array("_b")).alias("words"), "f", "first", "second", F.concat("pre", f).alias("pre"), F.concat("suf", f).alias("suf"))
        levels.append(written(grown, f"described{k}"))
        if k < longest:
            found = written(found_by_block(pair_numbers(lists, frequent)), f"found{k}")
            before, lists = lists, written(longer_lists(lists.join(found, "block")), f"lists{k}")
            for used in (before, found):
                drop_written(used)
        drop_written(frequent)
    drop_written(lists)
    return levels, total


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def candidates(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more that no longer one replaces."""
    out = []
    for k, level in enumerate(levels[1:], 2):
        kept = level
        if k < len(levels):  # if a much longer phrase replaces one, so does one that is a word longer
            over = levels[k].select(F.explode(F.array("first", "second")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_over"))
            inside = F.col("_over").isNotNull() & (_exact(F.col("_over")) * 100 >= _exact(F.col("f")) * REPLACED)
            kept = level.join(over, "id", "left").where(~inside)
        cuts = F.array(*(
            F.struct(
                F.expr(f"(CAST(f AS DECIMAL(38,0)) * 2000000) DIV (CAST(pre[{j - 1}] AS DECIMAL(38,0)) + CAST(suf[{k - j - 1}] AS DECIMAL(38,0)))").alias("score"),
                F.lit(j).alias("k"), F.expr(f"pre[{j - 1}]").alias("l"), F.expr(f"suf[{k - j - 1}]").alias("r"),
            )
            for j in range(1, k)
        ))
        cut = F.array_min(cuts)
        out.append(kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), cut.alias("_c")).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score"))
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_


def best_phrases(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of each language.

    A phrase is scored at its weakest cut. Defined cases: a null lang is ``und``; null and blank texts have
    no words; phrases keep inside a piece of one text; occurrences may overlap; repeated rows count each time;
    a text must fit in a worker; an empty table gives no rows; other columns are ignored.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    with scratch() as keep, tidy_shuffles(docs.sparkSession):
        levels, total = frequent_phrases(docs, longest, least, block_bytes)
        keep(total)
        found = keep(written(candidates(levels).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), "candidates"))
    some = found.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
