"""Light binaries as a data source: ``spark.read.format("light_binaries")`` and ``write.format("light_binaries")``.

Reading plans byte ranges: small files share a partition, large ones are cut into several, and each task finds the
records of its share from the file's header. Filters on ``item_id`` drop files before any is opened, filters on
``frame_idx`` narrow the records that are read; content comes as Arrow batches.

Writing takes rows with the header columns, in runs of one title sorted by frame. Every task writes its runs as part
files under hidden names and tells of them; the commit gives a title that came from one task its name by a rename and
joins the ranges of a title that came from several; an abort removes the parts. A reader never sees half a file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from rimlight.functions.packed import binary_column, byte_rows
from rimlight.model import BINARY_HEADER_BYTES, BINARY_MAGIC, FORMAT_RGBW, TIMESTAMP_BYTES
from rimlight.sources.files import open_folder, open_path

FORMAT = "light_binaries"
SCHEMA = "item_id string, frame_idx bigint, ts_us bigint, payload binary"
HEADER = ("fps", "top", "bottom", "left", "right", "fmt")
_HEADER = "<4sf4HB"
_SUFFIX = ".bin"
#: Bytes of files in one read partition, and records in one batch.
RANGE_BYTES = 64 << 20
BATCH_RECORDS = 4096


class LightBinaries(DataSource):
    """Options: ``path``; ``rangeBytes`` for reading."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = {"item_id", "frame_idx", "ts_us", "payload", *HEADER} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return _Writer(self.options["path"])


@dataclass
class _Share(InputPartition):
    """Files with the share (number, of how many) of their records that one task reads."""

    files: list[tuple[str, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes
        self.items: set[str] | None = None
        self.low, self.high = 0, 2**62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "item_id" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.items = wanted if self.items is None else self.items & wanted
            elif column == "frame_idx" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, root = open_path(self.path)
        shares: list[_Share] = []
        room = 0
        for info in sorted(system.get_file_info(pafs.FileSelector(root)), key=lambda i: i.path):
            item = info.base_name.removesuffix(_SUFFIX)
            if not info.is_file or item == info.base_name or info.base_name.startswith(".") or info.size <= BINARY_HEADER_BYTES:
                continue
            if self.items is not None and item not in self.items:
                continue
            of = -(-info.size // self.range_bytes)
            if of > 1:
                shares += [_Share([(info.base_name, info.size, no, of)]) for no in range(of)]
                room = 0
            elif info.size <= room:
                shares[-1].files.append((info.base_name, info.size, 0, 1))
                room -= info.size
            else:
                shares.append(_Share([(info.base_name, info.size, 0, 1)]))
                room = self.range_bytes - info.size
        return shares or [_Share([])]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        system, root = open_path(self.path)
        for name, size, no, of in partition.files:
            with system.open_input_file(f"{root}/{name}") as file:
                magic, _, *sides, fmt = struct.unpack(_HEADER, file.read(BINARY_HEADER_BYTES))
                if magic != BINARY_MAGIC:
                    continue
                step = TIMESTAMP_BYTES + sum(sides) * (4 if fmt == FORMAT_RGBW else 3)
                records = (size - BINARY_HEADER_BYTES) // step
                first, end = max(self.low, records * no // of), min(self.high, records * (no + 1) // of)
                for at in range(first, end, BATCH_RECORDS):
                    n = min(BATCH_RECORDS, end - at)
                    file.seek(BINARY_HEADER_BYTES + at * step)
                    raw = np.frombuffer(file.read(n * step), np.uint8).reshape(n, step)
                    stamps = np.ascontiguousarray(raw[:, :TIMESTAMP_BYTES]).view("<i8").ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.removesuffix(_SUFFIX)] * n), pa.array(np.arange(at, at + n)), pa.array(stamps), binary_column(raw[:, TIMESTAMP_BYTES:])],
                        names=["item_id", "frame_idx", "ts_us", "payload"])


@dataclass
class _Parts(WriterCommitMessage):
    """(item, first frame, last frame, file) of the part files that a task wrote."""

    parts: list[tuple[str, int, int, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = open_folder(self.path)
        parts: list[list] = []
        out = None
        try:
            for batch in iterator:
                items = np.array(batch.column("item_id").to_pylist(), object)
                frames = batch.column("frame_idx").to_numpy()
                # a run ends where the title changes or its frames do not rise
                cut = np.flatnonzero((items[1:] != items[:-1]) | (frames[1:] <= frames[:-1])) + 1
                for start, end in zip([0, *cut], [*cut, len(items)]):
                    if start == end:
                        continue
                    run = batch.slice(start, end - start)
                    if not parts or parts[-1][0] != items[start] or frames[start] <= parts[-1][2]:
                        if out is not None:
                            out.close()
                        name = f"{root}/.{items[start]}.{uuid.uuid4().hex}.part"
                        out = system.open_output_stream(name)
                        parts.append([items[start], int(frames[start]), 0, name])
                        out.write(struct.pack(_HEADER, BINARY_MAGIC, *[run.column(c)[0].as_py() for c in HEADER]))
                    stamps = run.column("ts_us").to_numpy().astype("<i8")
                    out.write(np.concatenate([stamps.view(np.uint8).reshape(-1, TIMESTAMP_BYTES), byte_rows(run.column("payload"))], axis=1).tobytes())
                    parts[-1][2] = int(frames[end - 1])
            if out is not None:
                out.close()
        except Exception:
            if out is not None:
                out.close()
            _remove(system, [p[3] for p in parts])
            raise
        return _Parts([tuple(p) for p in parts])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = open_folder(self.path)
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        for (item, _, last, _), (other, first, _, _) in zip(parts, parts[1:]):
            if item == other and first <= last:
                _remove(system, [p[3] for p in parts])
                raise ValueError(f"frames of {item} overlap between tasks")
        for item, group in groupby(parts, key=lambda p: p[0]):
            own = [p[3] for p in group]
            if len(own) > 1:
                _join(system, own)
            system.move(own[0], f"{root}/{item}{_SUFFIX}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = open_folder(self.path)
        _remove(system, [p[3] for m in messages if m is not None for p in m.parts])


def _join(system: pafs.FileSystem, parts: list[str]) -> None:
    """The first part becomes the whole: header once, then the records of all parts in order."""
    whole = f"{parts[0]}.whole"
    with system.open_output_stream(whole) as out:
        for no, part in enumerate(parts):
            with system.open_input_file(part) as file:
                file.seek(BINARY_HEADER_BYTES if no else 0)
                while data := file.read(16 << 20):
                    out.write(data)
    _remove(system, parts)
    system.move(whole, parts[0])


def _remove(system: pafs.FileSystem, names: list[str]) -> None:
    for name in names:
        if system.get_file_info(name).type != pafs.FileType.NotFound:
            system.delete_file(name)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LightBinaries)


def read_light_binaries(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("path", folder).option("rangeBytes", range_bytes).load()


def save_light_binaries(frames: DataFrame, titles: DataFrame, folder: str) -> None:
    """One binary per title, all of them at the end or none. Titles are dealt out by ranges of (title, frame), so a
    long one is written by several tasks."""
    register(frames.sparkSession)
    order = ["item_id", "frame_idx"]
    rows = frames.select(*order, "ts_us", "payload").join(titles.select("item_id", *HEADER), "item_id")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.format(FORMAT).option("path", folder).mode("append").save()
