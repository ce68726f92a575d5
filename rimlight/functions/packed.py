"""Packed light bytes <-> channel values, and measures on whole payloads."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rimlight.model import LUMA_WEIGHTS


def pack_bytes(values: Column) -> Column:
    """array of 0..255 -> binary."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def unpack_bytes(payload: Column) -> Column:
    """binary -> array<int>."""
    size = F.length(payload)
    return F.when(size == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(1), size), lambda i: byte_at(payload, i)))


def byte_at(payload: Column, position: Column | int) -> Column:
    """Value of one byte, 1-based."""
    pos = position if isinstance(position, Column) else F.lit(position)
    return F.conv(F.hex(F.substring(payload, pos, F.lit(1))), 16, 10).cast("int")


def rotation(input_position: Column, total: Column) -> Column:
    """By how many lights the strip is turned."""
    return F.when(total > 0, F.abs(input_position) % total).otherwise(F.lit(0))


def rotate_payload(payload: Column, turn: Column, channels: Column | int) -> Column:
    """out[i] = in[(i + turn) mod n] on packed bytes."""
    ch = channels if isinstance(channels, Column) else F.lit(channels)
    cut = turn * ch
    return F.when(turn == 0, payload).otherwise(F.concat(
        F.substring(payload, cut + 1, F.length(payload) - cut),
        F.substring(payload, F.lit(1), cut)))


def _matrix(payloads: pd.Series) -> np.ndarray:
    """Equal-length payloads as one (rows, bytes) array."""
    return np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(len(payloads), -1)


def _by_length(lengths: pd.Series) -> list[np.ndarray]:
    return [np.flatnonzero(lengths.to_numpy() == n) for n in lengths.unique()]


@F.pandas_udf(T.DoubleType())
def payload_delta(left: pd.Series, right: pd.Series) -> pd.Series:
    """Mean absolute channel difference of two payloads, 0..1; null when they cannot be compared."""
    size = left.map(lambda b: -1 if b is None else len(b))
    out = np.full(len(left), np.nan)
    same = size.where(size == right.map(lambda b: -2 if b is None else len(b)), -1)
    for rows in _by_length(same):
        if same.iloc[rows[0]] > 0:
            a, b = (_matrix(s.iloc[rows]).astype(np.int16) for s in (left, right))
            out[rows] = np.abs(a - b).sum(axis=1) / (a.shape[1] * 255.0)
    return pd.Series(out).where(~np.isnan(out), None)


@F.pandas_udf(T.DoubleType())
def payload_luminance(payload: pd.Series, channels: pd.Series) -> pd.Series:
    """Mean luminance of a packed frame; the white channel is ignored."""
    out = np.zeros(len(payload))
    shape = payload.map(len) * 8 + channels
    for rows in _by_length(shape):
        ch = int(channels.iloc[rows[0]])
        rgb = _matrix(payload.iloc[rows]).reshape(len(rows), -1, ch)[..., :3].astype(np.int64)
        if rgb.shape[1]:
            out[rows] = (rgb @ np.array(LUMA_WEIGHTS)).sum(axis=1) / (rgb.shape[1] * 10_000)
    return pd.Series(out)


def byte_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, bytes) of a binary column whose values are equally long and not null, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(column), -1)


def binary_column(rows: np.ndarray, here: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as packed binaries; with ``here``, rows for its true places and null elsewhere."""
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * int(np.prod(rows.shape[1:]))
    here = np.ones(len(rows), bool) if here is None else here
    ends = np.concatenate(([0], np.cumsum(here * size))).astype(np.int64)
    valid = np.packbits(here, bitorder="little")
    large = pa.Array.from_buffers(pa.large_binary(), len(here), [pa.py_buffer(valid), pa.py_buffer(ends), pa.py_buffer(rows)])
    return large.cast(pa.binary())
