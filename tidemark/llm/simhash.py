"""SimHash near-duplicates found through deletion-variant signatures.

A fingerprint is cut into segments so that, within the distance looked for, one segment differs
by at most one bit: d bits over m segments leave every segment with two or more only if d >= 2m.
Each segment is indexed once per bit with that bit wildcarded; fingerprints that are equal on a
variant are compared in full. Buckets never emit all their pairs: a bucket yields a spanning
forest of its links, and a bucket of thousands is cut into block pairs that go to separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, columns_of, restored, scratch, shielded, text_slices, tidy_shuffles, written
from tidemark.llm.components import connected_components, local_labels

#: Members of a bucket that one task compares with each other; larger buckets are cut into blocks of this.
BLOCK = 4096
#: One fingerprint in so many is counted to find the buckets that have to be cut.
PLAN_SHARE = 64
#: Pairs held at once in a task before they are folded into a forest.
PAIRS = 1 << 20
#: Distinct shingles whose texts one task compares with each other; groups with more are cut into blocks of this.
SHINGLES = 1 << 20
#: Sets smaller than this are compared whatever their fingerprints say: few votes make bits less sure.
FEW = 32
#: Most shingles whose frequency decides their place in the order of prefixes.
COMMON = 100_000

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``width``-word shingle of A-Z lower-cased UTF-8 text, repeats kept."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(b" ".join(words), 42)], dtype=np.uint64)
    parts = zip(*(words[k:] for k in range(width)), strict=False)
    return np.fromiter((h(b" ".join(p), 42) for p in parts), dtype=np.uint64, count=len(words) - width + 1)


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; further lanes are mixed from it."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(lane) * np.uint64(_MIX[0])
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
        return z ^ (z >> np.uint64(31))


def _majority(hashes: np.ndarray, lanes: int) -> list[int]:
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = np.ascontiguousarray(_lane(hashes[at : at + (1 << 16)], lane))
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = (2 * ones > len(hashes)).astype(np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view(np.int64)[0]))
    return out


def fingerprint(text: bytes, width: int, lanes: int = 1) -> list[int]:
    """Majority bits of the shingle hashes, 64 a lane; zero without words."""
    return _majority(shingle_hashes(text, width), lanes)


def fingerprints(docs: DataFrame, width: int = 5, lanes: int = 1, text: str = "text") -> DataFrame:
    """``docs`` with long columns _f0, _f1, ... added in front; every column of ``docs`` is kept.

    A null text counts as empty; a text of any length is taken whole. A taken name gets more underscores.
    """
    rows, inner = shielded(docs, (text,))
    names = [f"_f{k}" for k in range(lanes)]
    schema = ", ".join(f"{n} long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            prints = [fingerprint((t or "").encode(), width, lanes) for t in batch[text].to_pylist()]
            cols = [pa.array([p[k] for p in prints], pa.int64()) for k in range(lanes)]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns], names=[*names, *batch.schema.names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return restored(arrow_map(rows, run, f"{schema}, {kept}"), docs, inner, *names, front=True)


def segments(bits: int, count: int) -> list[tuple[int, int, int]]:
    """(lane, offset, size) of ``count`` near-equal segments that don't cross 64-bit lanes."""
    lanes = bits // 64
    share = [count // lanes + (k < count % lanes) for k in range(lanes)]
    out = []
    for lane, n in enumerate(share):
        sizes = [64 // n + (k < 64 % n) for k in range(n)]
        out += [(lane, sum(sizes[:k]), s) for k, s in enumerate(sizes)]
    return out


def _variants(nodes: DataFrame, lanes: int, count: int) -> DataFrame:
    keys, slot = [], 0
    for lane, offset, size in segments(64 * lanes, count):
        part = F.shiftrightunsigned(F.col(f"_f{lane}"), offset).bitwiseAND(F.lit((1 << size) - 1))
        for bit in range(size):
            wild = ((1 << size) - 1) & ~(1 << bit)
            keys.append(part.bitwiseAND(F.lit(wild)).bitwiseOR(F.lit(slot << 32)))
            slot += 1
    return nodes.select("node", *(f"_f{k}" for k in range(lanes)), F.explode(F.array(*keys)).alias("key"))


def _may_be_close(far: np.ndarray, max_bits: int, a: np.ndarray | None, b: np.ndarray | None, beyond: int) -> np.ndarray:
    """Which pairs ``far`` bits apart are linked; with set sizes a and b, those over ``beyond`` that can be 0.8 alike."""
    near = far <= max_bits
    if a is None:
        return near
    less, more = np.minimum(a, b), np.maximum(a, b)
    return (near | (less < FEW)) & (far > beyond) & (5 * less >= 4 * more)


def forest(lanes: np.ndarray, max_bits: int, rows: int = 128, size: np.ndarray | None = None, beyond: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as index pairs, of the links among fingerprints given as (n, lanes) uint64."""
    n, i, j, held = len(lanes), [], [], 0
    for at in range(0, n, rows):
        left, right = lanes[at : at + rows], lanes[at:]
        far = np.zeros((len(left), len(right)), np.uint8 if lanes.shape[1] < 4 else np.uint16)
        for k in range(lanes.shape[1]):
            far += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
        sizes = (None, None) if size is None else (size[at : at + rows, None], size[None, at:])
        a, b = np.nonzero(_may_be_close(far, max_bits, *sizes, beyond))
        up = a < b
        i.append(a[up] + at)
        j.append(b[up] + at)
        held += int(up.sum())
        if held > PAIRS:
            lab = local_labels(n, np.concatenate(i), np.concatenate(j))
            on = np.nonzero(lab != np.arange(n))[0]
            i, j, held = [on], [lab[on]], 0
    lab = local_labels(n, np.concatenate(i), np.concatenate(j)) if n else np.zeros(0, np.int64)
    on = np.nonzero(lab != np.arange(n))[0]
    return on, lab[on]


def _bucket_links(lanes: int, max_bits: int, sized: bool = False, beyond: int = -1):
    """Over rows sorted by bucket: forest edges (a, b) of each bucket; ``sized`` rows have a column size, and count if over ``beyond`` bits apart."""

    def links(node: np.ndarray, f: np.ndarray, n: np.ndarray | None, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = ends - starts
        small = size <= 32
        last = np.repeat(np.where(small, ends, 0), size)
        at = np.arange(len(node))
        for step in range(1, int(size[small].max(initial=1))):
            at = at[at + step < last[at]]
            if not len(at):
                break
            far = np.bitwise_count(f[at] ^ f[at + step]).sum(1)
            sizes = (None, None) if n is None else (n[at], n[at + step])
            hit = at[_may_be_close(far, max_bits, *sizes, beyond)]
            a.append(node[hit])
            b.append(node[hit + step])
        for s, e in zip(starts[~small], ends[~small], strict=True):
            i, j = forest(f[s:e], max_bits, size=None if n is None else n[s:e], beyond=beyond)
            a.append(node[s:e][i])
            b.append(node[s:e][j])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "p", "q"]
        rest: pa.Table | None = None

        def work(table: pa.Table) -> pa.RecordBatch | None:
            cols = [np.asarray(table[c].combine_chunks()) for c in names]
            new = np.ones(len(table), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            starts = np.nonzero(new)[0]
            ends = np.append(starts[1:], len(table))
            f = np.stack([np.asarray(table[f"_f{k}"].combine_chunks()).view(np.uint64) for k in range(lanes)], 1)
            n = np.asarray(table["size"].combine_chunks()).astype(np.int64) if sized else None
            a, b = links(np.asarray(table["node"].combine_chunks()), f, n, starts, ends)
            if not len(a):
                return None
            ab = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            if rest is not None:
                table = pa.concat_tables([rest, table])
            tail = [table[c][-1].as_py() for c in names]
            same = np.logical_and.reduce(
                [np.asarray(table[c].combine_chunks()) == v for c, v in zip(names, tail, strict=True)]
            )
            cut = int(len(table) - same[::-1].argmin()) if not same.all() else 0
            rest = table.slice(cut)
            if cut and (out := work(table.slice(0, cut))) is not None:
                yield out
        if rest is not None and (out := work(rest)) is not None:
            yield out

    return run


def fingerprint_links(nodes: DataFrame, lanes: int, max_bits: int, count: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links at ``max_bits`` or fewer differing bits.

    ``nodes`` has a long ``node``, one row each, and the fingerprint in ``_f0``...
    With ``2 * count > max_bits`` no link can be missed.
    """
    names = [f"_f{k}" for k in range(lanes)]
    part = nodes.where(F.pmod(F.xxhash64(*names), F.lit(PLAN_SHARE)) == 0)
    dealt = _dealt(_variants(part, lanes, count), _variants(nodes, lanes, count), ["node", *names])
    return arrow_map(dealt, _bucket_links(lanes, max_bits), "a long, b long")


def _dealt(part: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` sorted by bucket: key, and block numbers p and q where ``part``, one row in PLAN_SHARE, tells that a key is hot."""
    planned = (
        part.groupBy("key")
        .count()
        .where(F.col("count") * PLAN_SHARE > BLOCK // 2)
        .select("key", F.ceil(F.col("count") * PLAN_SHARE / BLOCK).cast("int").alias("blocks"))
    )
    hot = written(planned, "hot-buckets")
    rows = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn(
        "other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), *columns)
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def groups_of(prints: DataFrame, lanes: int, max_bits: int, count: int) -> DataFrame:
    """(_f0.., low, root): of each distinct fingerprint the smallest non-null doc_id and its group's root.

    ``prints`` needs doc_id and the ``_f`` columns of ``fingerprints``.
    """
    names = [f"_f{k}" for k in range(lanes)]
    node = F.xxhash64(*names) if lanes > 1 else F.col("_f0")
    classes = written(prints.groupBy(*names).agg(F.min("doc_id").alias("low")).withColumn("node", node), "fingerprints")
    roots = connected_components(fingerprint_links(classes, lanes, max_bits, count))
    joined = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return written(joined.select(*names, "low", "root"), "members")


def components_of(docs: DataFrame, width: int = 4, max_bits: int = 4, lanes: int = 1, count: int = 3) -> DataFrame:
    """(doc_id, fingerprint hex, component_id, root) for every row of ``docs``.

    Defined cases: a null or blank text has fingerprint zero and links like any other; repeated rows
    and repeated ids give a row each; a null doc_id never names a component but its text links;
    very long texts are taken whole; an empty table gives no rows; other columns are ignored,
    whatever their names, also where one differs in case only.
    """
    names = [f"_f{k}" for k in range(lanes)]
    with scratch() as keep:
        prints = keep(written(fingerprints(columns_of(docs, "doc_id", "text"), width, lanes).drop("text"), "prints"))
        members = keep(groups_of(prints, lanes, max_bits, count))
    low = members.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = members.join(low, "root").select(*names, "root", "component_id")
    hexes = F.concat(*(F.lower(F.lpad(F.hex(n), 16, "0")) for n in names))
    return prints.join(groups, names).select("doc_id", hexes.alias("fingerprint"), "component_id", "root")


def _close(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with ``both`` in common have a Jaccard similarity of 0.8 or more."""
    return 9 * both >= 4 * (a + b)


def prefix_sizes(sizes: np.ndarray) -> np.ndarray:
    """How many first elements of a set, in any order common to all, meet those of every set that is 0.8 alike."""
    return np.where(sizes > 0, sizes - (4 * sizes + 4) // 5 + 1, 0)


def similar_sets(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what all pairs of distinct-valued sets at 0.8 or more connect; each pair is such a pair."""
    n, i, j = len(sets), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sizes = np.array([len(x) for x in sets], np.int64)
    at = np.append(0, np.cumsum(sizes))
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), sizes)
    rarest = np.lexsort((ids, often[ids], doc))
    own = rarest[np.arange(len(ids)) - at[doc] < prefix_sizes(sizes)[doc]]
    tok, doc = ids[own], doc[own]
    by = np.lexsort((doc, tok))
    tok, doc = tok[by], doc[by]
    label, mark = np.arange(n), np.zeros(len(often), bool)
    for s in range(n):
        if not s & (s - 1) and len(tok):  # now and then drop elements whose sets are all connected
            first = np.nonzero(np.append(True, tok[1:] != tok[:-1]))[0]
            mixed = np.minimum.reduceat(label[doc], first) != np.maximum.reduceat(label[doc], first)
            on = np.repeat(mixed, np.diff(np.append(first, len(tok))))
            tok, doc = tok[on], doc[on]
            first = np.nonzero(np.append(True, tok[1:] != tok[:-1]))[0] if len(tok) else np.zeros(0, np.int64)
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(tok))))
            by_doc = np.argsort(doc, kind="stable")
            runs, begin, bounds = run[by_doc], np.searchsorted(doc[by_doc], np.arange(n + 1)), np.append(first, len(tok))
        if not len(tok):
            break
        others = [doc[bounds[r] : bounds[r + 1]] for r in runs[begin[s] : begin[s + 1]]]
        if not others:
            continue
        c = np.concatenate(others)
        c = np.unique(c[(c > s) & (label[c] != label[s])])
        c = c[5 * np.minimum(sizes[c], sizes[s]) >= 4 * np.maximum(sizes[c], sizes[s])]
        if not len(c):
            continue
        mark[ids[at[s] : at[s + 1]]] = True
        both = np.array([np.count_nonzero(mark[ids[at[k] : at[k + 1]]]) for k in c])
        mark[ids[at[s] : at[s + 1]]] = False
        hit = c[_close(sizes[c], sizes[s], both)]
        if len(hit):
            i.append(np.full(len(hit), s))
            j.append(hit)
            joined = np.unique(np.append(label[hit], label[s]))
            label[np.isin(label, joined)] = joined[0]
    return np.concatenate(i), np.concatenate(j)


def _verified_links(width: int):
    """Over rows sorted by root, p, q: links (a, b) among each group's texts by the shingles themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}

        def told() -> pa.RecordBatch | None:
            if len(sets) < 2:
                return None
            nodes = np.fromiter(sets, np.int64, len(sets))
            i, j = similar_sets(list(sets.values()))
            return pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], names=["a", "b"])

        for batch in text_slices(batches, "text"):
            rows = zip(*(batch[c].to_pylist() for c in ("root", "p", "q", "node", "text")), strict=True)
            for root, p, q, node, text in rows:
                if (root, p, q) != now:
                    if (out := told()) is not None:
                        yield out
                    now, sets = (root, p, q), {}
                if node not in sets:
                    sets[node] = np.unique(shingle_hashes((text or "").encode(), width))
        if (out := told()) is not None:
            yield out

    return run


def verified_edges(docs: DataFrame, classes: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """Edges (a, b) that connect what the pairs of ``classes`` at 0.8 or more connect inside the components of ``candidates``.

    ``classes`` has node, best (the row that stands for it) and size (its distinct shingles). A large
    component is cut into blocks whose pairs go to separate tasks.
    """
    members = connected_components(candidates).join(classes.select("node", "size", "best.doc_id", "best._h"), "node")
    blocks = members.groupBy("root").agg(F.ceil(F.sum("size") / SHINGLES).cast("int").alias("blocks"))
    members = members.join(blocks, "root").withColumnsRenamed({"doc_id": "_d", "_h": "_g"})
    members = written(members.withColumn("blocks", F.greatest("blocks", F.lit(1))), "candidates")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_g"))
    rows = docs.select("doc_id", "text").join(members, on).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "text")
    dealt = rows.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
    return arrow_map(dealt, _verified_links(width), "a long, b long")


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several of a sample of texts hold, and in how many.

    They only order the prefixes: with any order no pair is lost, with this one common passages make few candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = [np.unique(shingle_hashes((t or "").encode(), width)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(PLAN_SHARE)) == 0)
    often = arrow_map(part, run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON)
    rows = often.collect()
    h, n = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def set_prints(docs: DataFrame, width: int, lanes: int) -> DataFrame:
    """(doc_id, _h, node, size, prefix, _f0..): hash, size and prefix of each text's set of shingles, and its fingerprint.

    ``docs`` has doc_id, text and _h, the text's hash. Sets that are 0.8 alike have a shingle of their prefixes in common.
    """
    names = [f"_f{k}" for k in range(lanes)]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    known, often = common_shingles(docs, width)

    def prefix(x: np.ndarray) -> np.ndarray:
        n = int(prefix_sizes(np.array([len(x)]))[0])
        if not len(known):
            return x[:n]
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return x[np.argsort(np.where(known[at] == x, often[at], 0), kind="stable")[:n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = [np.unique(shingle_hashes((t or "").encode(), width)) for t in batch["text"].to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            rows = [_majority(x, lanes) for x in sets]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(lanes)]
            size = pa.array([len(x) for x in sets], pa.int32())
            firsts = pa.array([prefix(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["_h"], pa.array(node), size, firsts, *cols], names=["doc_id", "_h", "node", "size", "prefix", *names]
            )

    schema = f"doc_id {id_type}, _h long, node long, size int, prefix array<long>, "
    return arrow_map(docs, run, schema + ", ".join(f"{n} long" for n in names))


def prefix_links(classes: DataFrame, lanes: int, max_bits: int, beyond: int) -> DataFrame:
    """Edges (a, b) that connect all pairs of ``classes`` with a shingle of their prefixes in common, sizes that allow a
    similarity of 0.8, and fingerprints more than ``beyond`` and at most ``max_bits`` apart, or fewer than FEW shingles
    and more than ``beyond``."""
    columns = ["node", "size", *(f"_f{k}" for k in range(lanes))]
    keyed = lambda df: df.select(*columns, F.explode("prefix").alias("key"))
    part = classes.where(F.pmod(F.xxhash64("node"), F.lit(PLAN_SHARE)) == 0)
    dealt = _dealt(keyed(part), keyed(classes), columns)
    return arrow_map(dealt, _bucket_links(lanes, max_bits, True, beyond), "a long, b long")


def keep_one(docs: DataFrame, width: int = 5, lanes: int = 2, near: int = 15, count: int = 8, max_bits: int = 42) -> DataFrame:
    """``docs`` with one row left of each near-duplicate group, every column kept.

    A group is what pairs with a Jaccard similarity of 0.8 or more between their sets of five-word
    shingles connect. Deletion variants of the fingerprints' ``count`` segments find every pair at most
    ``near`` bits apart (``2 * count > near``). Similar pairs can be farther apart (at 0.8 they are 19.4
    of 128 bits apart, with a deviation of 4.1), and segments that lose none of those would select
    nothing. Such a pair shares one of the rarest fifth of its shingles: buckets of these find what is
    over ``near`` bits apart; ``max_bits`` + 1 or more rule a pair out. The shingles themselves decide on
    both. The row with the smallest doc_id stays (null ids last, then the smallest text hash); of equal
    rows one stays.
    """
    names = [f"_f{k}" for k in range(lanes)]
    key = F.xxhash64("text")
    outer, (docs, inner) = docs, shielded(docs)
    with scratch() as keep:
        prints = written(set_prints(docs.select("doc_id", "text", key.alias("_h")), width, lanes), "prints")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("best")
        same = [F.first(c).alias(c) for c in ("size", "prefix", *names)]
        classes = written(prints.groupBy("node").agg(best, *same), "classes")
        with tidy_shuffles(docs.sparkSession):
            close = written(fingerprint_links(classes, lanes, near, count), "close")
        found = close.unionByName(prefix_links(classes, lanes, max_bits, near))
        roots = connected_components(verified_edges(docs, classes, found, width))
        groups = classes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
        kept = groups.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best._h")
        kept = kept.join(
            prints.groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).agg(F.count("*").alias("_n")),
            F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")),
        ).select("_d", "_g", "_n")
        kept = keep(written(kept, "kept"))
    on = docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_g"))
    one = docs.join(kept.where("_n = 1"), on, "left_semi")
    if kept.where("_n > 1").isEmpty():
        return restored(one, outer, inner)
    again = docs.join(kept.where("_n > 1"), on, "left_semi").dropDuplicates(["doc_id", "text"])
    return restored(one.unionByName(again), outer, inner)
