"""A table of the newest row of each key that batches are merged into, and that is read at a cost that batches do not raise.

A batch becomes a run: its newest row of each key, in a folder of its own. ``fan`` runs of a level are merged into one of
the next; the highest level has one run. So a read meets fewer than ``fan`` runs of each level, however many batches there
were, and a row is rewritten about once a level, but for merges into the highest. A manifest names the runs and the last
batch; it is one file, written last, so a merge that dies leaves the table as it was, and a batch that comes again after
its merge changes nothing. Four manifests are kept, for reads that are under way; older runs are deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lotflow.operators.dedup import keep_last

_SLOTS = 4
_MANIFEST = "n long, batch_id long, level int, run string"


class Upserts:
    """The newest row of each of ``keys`` by batch, and inside a batch by ``order``; rows have the columns of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], order: list[str], fan: int = 8, levels: int = 3):
        self.spark, self.path, self.keys, self.order, self.fan, self.top = spark, path, keys, order, fan, levels - 1
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._stored = StructType([*self.schema.fields, *StructType.fromDDL("_batch long").fields])

    def _manifests(self) -> list:
        """Rows of all manifests that are there; a slot that was never written, or that is being written, has none."""
        fs, found = self._files(), []
        for slot in range(_SLOTS):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/slot={slot}")
            if fs.exists(at):
                found += self.spark.read.schema(_MANIFEST).parquet(str(at)).collect()
        return found

    def _files(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _newest(self, rows: list) -> tuple[int, int, list[tuple[int, str]]]:
        n = max((r.n for r in rows), default=0)
        mine = [r for r in rows if r.n == n]
        return n, mine[0].batch_id if mine else -1, sorted((r.level, r.run) for r in mine)

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(f"{self.path}/data/{name}")

    def _write(self, rows: DataFrame, batch_id: int) -> str:
        """Only the newest row of each key of ``rows``, as a new run."""
        name = f"{batch_id:010d}-{uuid.uuid4().hex}"
        keep_last(rows, self.keys, ["_batch", *self.order]).write.parquet(f"{self.path}/data/{name}")
        return name

    def _publish(self, n: int, batch_id: int, runs: list[tuple[int, str]]) -> None:
        rows = self.spark.createDataFrame([(n, batch_id, *r) for r in runs], _MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/slot={n % _SLOTS}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """A ``foreachBatch`` function: have the rows of a batch in the table."""
        known = self._manifests()
        n, last, runs = self._newest(known)
        if batch_id <= last:
            return
        runs = [*runs, (0, self._write(batch.select(*self.schema.names).withColumn("_batch", F.lit(batch_id).cast("long")), batch_id))]
        for level in range(self.top):
            full = [name for k, name in runs if k == level]
            if len(full) < self.fan:
                break
            above = [name for k, name in runs if k == self.top] if level + 1 == self.top else []
            merged = self._write(self._union([*full, *above]), batch_id)
            runs = [(k, name) for k, name in runs if name not in (*full, *above)] + [(level + 1, merged)]
        self._publish(n + 1, batch_id, runs)
        self._forget(known, {name for _, name in runs} | {r.run for r in known if r.n > n + 1 - _SLOTS})

    def _forget(self, known: list, needed: set[str]) -> None:
        fs = self._files()
        for name in {r.run for r in known} - needed:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}"), True)

    def _union(self, names: list[str]) -> DataFrame:
        out = self._run(names[0])
        for name in names[1:]:
            out = out.unionByName(self._run(name))
        return out

    def runs(self) -> list[tuple[int, str]]:
        """(level, name) of the runs that a read meets."""
        return self._newest(self._manifests())[2]

    def read(self) -> DataFrame:
        """The newest row of each key."""
        names = [name for _, name in self.runs()]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return keep_last(self._union(names), self.keys, ["_batch", *self.order]).drop("_batch")
