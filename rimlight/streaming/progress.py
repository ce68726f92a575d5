"""Reported progress as an upsert table: a snapshot, and the deltas of the batches after it.

``upsert`` is a ``foreachBatch`` function. A batch writes its newest report of every item into a folder named by its
number, so a repeated batch replaces what it wrote; every ``compact_every`` batches the snapshot and the deltas up to the batch
become a new snapshot, named by that number. A reader takes the newest complete snapshot and the deltas after it. A batch
that a snapshot already holds is not written again, and of equal items the newest report wins, in whatever order they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "item_id string, ts timestamp, frames_current long, frames_total long"
_REPORT = ("ts", "frames_current", "frames_total")


def newest(reports: DataFrame) -> DataFrame:
    """The latest report of every item; equal times go by the frames."""
    return reports.groupBy("item_id").agg(F.max(F.struct(*_REPORT)).alias("p")).select("item_id", "p.*")


class ProgressTable:
    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 20) -> None:
        self.spark, self.folder, self.compact_every = spark, folder, compact_every

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        done = self._snapshot()
        if batch_id <= done:
            return
        newest(batch.select("item_id", *_REPORT)).write.mode("overwrite").parquet(f"{self.folder}/delta/{batch_id}")
        if batch_id - done >= self.compact_every:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        """Snapshot of all batches up to one; what it replaces is dropped once it is complete."""
        before, deltas = self._snapshot(), [d for d in self._numbers("delta") if d <= upto]
        self._merged(before, deltas).write.mode("overwrite").parquet(f"{self.folder}/snapshot/{upto}")
        for old in [f"delta/{d}" for d in deltas] + ([f"snapshot/{before}"] if before >= 0 else []):
            self._fs().delete(self._path(old), True)

    def read(self) -> DataFrame:
        """One row per item: its latest report."""
        done = self._snapshot()
        return self._merged(done, [d for d in self._numbers("delta") if d > done])

    def _merged(self, snapshot: int, deltas: list[int]) -> DataFrame:
        paths = [f"snapshot/{snapshot}"] * (snapshot >= 0) + [f"delta/{d}" for d in deltas]
        reader = self.spark.read.schema(SCHEMA)
        rows = reader.parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows if snapshot >= 0 and not deltas else newest(rows)

    def _snapshot(self) -> int:
        return max(self._numbers("snapshot"), default=-1)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the folders that were written to the end."""
        fs = self._fs()
        if not fs.exists(self._path(kind)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(self._path(kind))]
        return sorted(int(n) for n in names if fs.exists(self._path(f"{kind}/{n}/_SUCCESS")))


def run_progress(reports: DataFrame, table: ProgressTable, checkpoint: str) -> None:
    """Upsert all reports that a stream has."""
    query = (reports.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
