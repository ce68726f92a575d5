"""Running a stream over everything that is there, into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rimlight.session import fresh_folder


def run_to_table(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process all available input and return the written rows.

    Every micro-batch writes its own folder, named by its number, so a repeated batch replaces
    what it wrote before. ``each`` may turn a micro-batch into the rows to write.
    """
    spark = stream.sparkSession
    out = fresh_folder(spark, "stream-out")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = each(batch) if each else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", fresh_folder(spark, "stream-state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not _written(spark, out):
        write(spark.createDataFrame([], stream.schema), 0)  # nothing came: a table without rows
    return spark.read.parquet(out)


def _written(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_events(
    spark: SparkSession, folder: str, schema, files_per_batch: int | None = None, bytes_per_batch: int = 256 << 20,
) -> DataFrame:
    """Stream of Parquet files, oldest first, in micro-batches of limited size.

    Events of one session should arrive in time order. The limit also bounds what a single hot
    session can bring into one task.
    """
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", bytes_per_batch)
    return spark.readStream.schema(schema).option(*limit).parquet(folder)
