"""Keyed tables kept by streams: runs of changes by bucket, merged on read and, level by level, in the background of batches.

A micro-batch writes the newest row of each of its keys as one run, by buckets of the key's hash, and no
more; ``fan`` runs of a level become one of the next, so a row is written again once a level and the
levels grow with the logarithm of the table. A manifest names the runs that count, the batches that are
in, and how to merge. A manifest is a file of its own number that appears by a rename, so a crash leaves
the table as it was before or after a step; files that no manifest names are never read.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a level that become one of the next, and manifests that are kept for readers.
FAN, KEPT = 8, 3


class KeyedTable:
    """The newest row of each key by ``order``, at ``path``. One writer at a time; any number of readers.

    ``expires`` names a timestamp after which a row counts as gone; such rows and rows with ``gone`` go for good once nothing older is left to hide.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, order: str | None = None, buckets: int = 64, expires: str | None = None, gone: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.said = {"keys": keys, "order": order, "buckets": buckets, "expires": expires, "gone": gone}

    # files

    def _fs(self, where: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("log") if n.endswith(".json") and not n.startswith(("_", "."))]

    def manifest(self) -> dict | None:
        """What the newest manifest says."""
        names = self._manifests()
        return json.loads(self.spark.read.text(f"{self.path}/log/{names[-1]}", wholetext=True).first()[0]) if names else None

    def _commit(self, said: dict) -> None:
        """The next manifest. It fails where another writer was faster."""
        fs, now = self._fs(f"{self.path}/log/{said['version']:020d}.json")
        _, new = self._fs(f"{self.path}/log/_{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(json.dumps(said).encode())
        out.close()
        if fs.exists(now) or not fs.rename(new, now):
            raise RuntimeError(f"another writer has made version {said['version']}")

    def _write_run(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return name

    def _runs(self, names: list[str], schema: str) -> DataFrame:
        out = [self.spark.read.schema(schema).parquet(f"{self.path}/data/{n}") for n in names]
        first = out[0]
        for more in out[1:]:
            first = first.unionByName(more)
        return first

    @staticmethod
    def _newest(rows: DataFrame, said: dict) -> DataFrame:
        """One row a key: the greatest by order, of equals that of the later batch. Partial results are merged before the shuffle."""
        columns = [c for c in rows.columns if c not in said["keys"] and c != "_bucket"]
        best = F.max_by(F.struct(*columns), F.struct(said["order"], "_batch")).alias("_r")
        return rows.groupBy("_bucket", *said["keys"]).agg(best).select(*said["keys"], "_r.*", "_bucket")

    @staticmethod
    def _live(rows: DataFrame, said: dict, now: Column | None) -> DataFrame:
        if said["gone"]:
            rows = rows.where(~F.coalesce(F.col(said["gone"]), F.lit(False)))
        if said["expires"] and now is not None:
            rows = rows.where(F.col(said["expires"]).isNull() | (F.col(said["expires"]) > now))
        return rows

    # writing

    def put(self, batch: DataFrame, epoch: int, stream: str = "") -> None:
        """Take in a micro-batch; one that is in already changes nothing."""
        said = self.manifest() or self.said | {"version": 0, "runs": [], "epochs": {}, "batch": 0, "schema": None}
        if said["epochs"].get(stream, -1) >= epoch:
            return
        number = said["batch"] + 1
        rows = batch.withColumn("_batch", F.lit(number).cast("long")).withColumn("_bucket", F.pmod(F.xxhash64(*said["keys"]), F.lit(said["buckets"])).cast("int"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        run = self._write_run(self._newest(rows, said).select(*rows.columns))
        self._commit(said | {"version": said["version"] + 1, "runs": [*said["runs"], [run, 0]], "epochs": said["epochs"] | {stream: epoch}, "batch": number, "schema": kinds})

    def compact(self, fan: int = FAN, now: Column | None = None) -> None:
        """Merge the newest ``fan`` runs of a level into one of the next, while any level has as many. The oldest run of all holds no rows that are gone."""
        while (said := self.manifest()) is not None:
            runs = said["runs"]  # oldest first, so levels fall
            level = next((lv for lv in sorted({r[1] for r in runs}) if sum(r[1] == lv for r in runs) >= fan), None)
            if level is None:
                return
            at = [k for k, r in enumerate(runs) if r[1] == level]
            rows = self._newest(self._runs([runs[k][0] for k in at], said["schema"]), said)
            if at[0] == 0:
                rows = self._live(rows, said, now)
            run = self._write_run(rows)
            self._commit(said | {"version": said["version"] + 1, "runs": [*runs[: at[0]], [run, level + 1], *runs[at[-1] + 1 :]]})

    def clean(self, kept: int = KEPT) -> None:
        """Remove manifests but the last ``kept``, and runs that none of these names."""
        names = self._manifests()
        named = {r[0] for n in names[-kept:] for r in json.loads(self.spark.read.text(f"{self.path}/log/{n}", wholetext=True).first()[0])["runs"]}
        for folder, gone in (("log", set(self._names("log")) - set(names[-kept:])), ("data", set(self._names("data")) - named)):
            for name in gone:
                fs, p = self._fs(f"{self.path}/{folder}/{name}")
                fs.delete(p, True)

    # reading

    def current(self, now: Column | None = None) -> DataFrame:
        """The newest row of each key, without those that are gone; with ``now``, without those that have expired by then."""
        said = self.manifest()
        if said is None:
            raise ValueError(f"nothing was written to {self.path}")
        return self._live(self._newest(self._runs([r[0] for r in said["runs"]], said["schema"]), said), said, now).drop("_batch", "_bucket")

    def lookup(self, **key: Any) -> DataFrame:
        """The row of one key: of each run, only the key's bucket is read."""
        said = self.manifest()
        rows = self._runs([r[0] for r in said["runs"]], said["schema"])
        kinds = dict(rows.dtypes)
        value = {k: F.lit(key[k]).cast(kinds[k]) for k in said["keys"]}
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*value.values()), F.lit(said["buckets"]))).first()[0]
        mine = rows.where(F.col("_bucket") == bucket)
        for k, v in value.items():
            mine = mine.where(F.col(k) == v)
        return self._live(self._newest(mine, said), said, None).drop("_batch", "_bucket")


def upserted(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, expires: str | None = None, gone: str | None = None, buckets: int = 64, fan: int = FAN):
    """Keep the newest row of each key at ``path``: a batch writes its own rows, and now and then runs are merged.

    A batch that runs again is known by the checkpoint it belongs to, so a new checkpoint over an old path goes on where that stands.
    """
    table = KeyedTable(stream.sparkSession, path, keys, order, buckets, expires, gone)

    def put(batch: DataFrame, epoch: int) -> None:
        table.put(batch, epoch, checkpoint)
        table.compact(fan, F.current_timestamp())
        table.clean()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """The table that ``upserted`` keeps at ``path``."""
    return KeyedTable(spark, path).current(now)
