"""File access from inside tasks, on any store that Arrow knows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


NAMES_PER_BATCH = 10_000


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, created if missing."""
    system, path = open_path(folder)
    system.create_dir(path, recursive=True)
    return system, path


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def empty_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """``(item_id)`` of files of length 0, which Spark's own readers never show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            fs, root = open_path(folder)
            names = [f.base_name.removesuffix(suffix) for f in fs.get_file_info(pafs.FileSelector(root))
                     if f.is_file and f.size == 0 and f.base_name.endswith(suffix)]
            for at in range(0, len(names), NAMES_PER_BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(names[at:at + NAMES_PER_BATCH], pa.string())], names=["item_id"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "item_id string")
