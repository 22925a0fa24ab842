"""Plumbing the training-data operators share: shared storage, narrow tables, text batches."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python task works on at once.
SLICE_BYTES = 1 << 20
#: Bytes of a record batch that Spark sends to a Python worker; a single longer row is a batch of its own.
SENT_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. Only a local session may lack one; it gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Tables written inside each open ``scratch``.
_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside go at the end, but for those given to what this yields: a lazy result still reads them."""
    mine: list[DataFrame] = []
    needed: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        needed.add(df._tidemark_path)
        return df

    _SCRATCH.append(mine)
    try:
        yield keep
    finally:
        _SCRATCH.remove(mine)
        for df in mine:
            if df._tidemark_path not in needed:
                drop_written(df)
            elif _SCRATCH:
                _SCRATCH[-1].append(df)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written inside go as soon as it is, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write the frame to the shared folder and read it back."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def rows_table(spark: SparkSession, rows: Iterable[dict], schema: str, tag: str) -> DataFrame:
    """Rows that the driver has, as a table that the JVM reads: no Python worker stands behind it."""
    path = new_path(spark, tag)
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows.json")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        lines = iter(rows)
        while part := "".join(json.dumps(r) + "\n" for r in islice(lines, 4096)):
            out.write(part.encode())
    finally:
        out.close()
    table = spark.read.schema(schema).json(path)
    table._tidemark_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(table)
    return table


def drop_written(df: DataFrame) -> None:
    """Remove what ``written`` wrote, once nothing reads it any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, idle, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, whose worker returns its memory after each output and at the end."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SENT_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in run(batches):
                yield out
                del out
                give_back()
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, met letter for letter first: others may differ from them only in case."""
    at = []
    for name in names:
        exact = [k for k, c in enumerate(df.columns) if c == name]
        alike = [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not (exact or alike):
            raise ValueError(f"no column {name}")
        at.append((exact or alike)[0])
    own = df.toDF(*(f"in_{k}" for k in range(len(df.columns))))
    return own.select(*(F.col(f"in_{k}").alias(name) for k, name in zip(at, names, strict=True)))


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def crc_of_id(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string"))


#: Columns of documents that operators read by name.
CORE = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame, core: tuple[str, ...] = CORE) -> tuple[DataFrame, list[str]]:
    """``docs`` with every column but the first of each ``core`` name under a name that nothing inside an operator uses, and the names now in place."""
    inner = [c if c in core and c not in docs.columns[:k] else f"in_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*inner), inner


def first_columns(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` columns, by place: names may differ in case only."""
    own = df.toDF(*(f"in_{k}" for k in range(len(df.columns))))
    return own.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(df.columns[:n])))


def restored(df: DataFrame, docs: DataFrame | list[str], inner: list[str], *extra: str, front: bool = False) -> DataFrame:
    """The columns of ``docs`` under their own names, and after (or before) them those of ``extra``, with underscores added where a name is taken."""
    names = docs if isinstance(docs, list) else docs.columns
    taken = {c.lower() for c in names}
    said = []
    for e in extra:
        name = e
        while name.lower() in taken:
            name += "_"
        said.append(F.col(e).alias(name))
    own = [F.col(i).alias(c) for i, c in zip(inner, names, strict=True)]
    return df.select(*said, *own) if front else df.select(*own, *said)
