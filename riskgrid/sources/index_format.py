"""The flat binary index as a data source: one file, little endian.

Layout (fixed values): int32 magic, int32 count, float32 min, float32 max, the columns of block A, those of block B (each
``count`` int16), and labels as bits, the lowest first. Register with ``spark.dataSource.register(FlatIndex)``.
"""

from __future__ import annotations

import glob
import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from riskgrid.config import BLOCK_A, BLOCK_B, DIMS

MAGIC = 0x52415A52
HEADER = struct.Struct("<iiff")
SCHEMA = "ref_id bigint, is_fraud boolean, " + ", ".join(f"q{i} smallint" for i in range(DIMS))
#: References read as a partition.
ROWS = 1 << 20


def encode(columns: dict[int, np.ndarray], labels: np.ndarray, low: float, high: float) -> bytes:
    parts = [HEADER.pack(MAGIC, len(labels), low, high)]
    parts += [np.ascontiguousarray(columns[i], "<i2").tobytes() for i in (*BLOCK_A, *BLOCK_B)]
    return b"".join([*parts, np.packbits(np.asarray(labels, bool), bitorder="little").tobytes()])


def header(data: bytes) -> tuple[int, float, float]:
    magic, count, low, high = HEADER.unpack(data[: HEADER.size])
    if magic != MAGIC:
        raise ValueError("Invalid magic")
    return count, low, high


@dataclass
class Slice(InputPartition):
    start: int
    stop: int

    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class FlatIndexReader(DataSourceReader):
    """Reads slices of references: each column's part is one seek and one read."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            count, _, _ = header(f.read(HEADER.size))
        return [Slice(i, min(count, i + ROWS)) for i in range(0, count, ROWS)] or [Slice(0, 0)]

    def read(self, partition):
        n = partition.stop - partition.start
        with open(self.path, "rb") as f:
            count, _, _ = header(f.read(HEADER.size))
            columns = {}
            for k, dim in enumerate((*BLOCK_A, *BLOCK_B)):
                f.seek(HEADER.size + 2 * (k * count + partition.start))
                columns[dim] = np.frombuffer(f.read(2 * n), "<i2")
            f.seek(HEADER.size + 2 * DIMS * count + partition.start // 8)
            bits = np.unpackbits(np.frombuffer(f.read(-(-n // 8) + 1), np.uint8), bitorder="little")
        labels = bits[:n].astype(bool)
        ids = np.arange(partition.start, partition.stop)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), *(pa.array(columns[i], pa.int16()) for i in range(DIMS))], names=["ref_id", "is_fraud", *(f"q{i}" for i in range(DIMS))])


@dataclass
class Part(WriterCommitMessage):
    path: str
    first: int


class FlatIndexWriter(DataSourceArrowWriter):
    """Each task writes a part; the commit lays the parts down column by column, reading a column of a part at a time.

    References are numbered in the order of the parts, so the frame should be one that is sorted by ref_id across partitions.
    """

    def __init__(self, options: dict):
        self.path, self.low, self.high = options["path"], float(options.get("min", "-1")), float(options.get("max", "1"))

    def write(self, iterator):
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Part("", -1)
        table = pa.Table.from_batches(batches).sort_by("ref_id")
        first = table["ref_id"][0].as_py()
        path = f"{self.path}.part-{first:020d}-{os.getpid()}"
        with open(path, "wb") as f:
            f.write(encode({i: table[f"q{i}"].to_numpy() for i in range(DIMS)}, table["is_fraud"].to_numpy(), self.low, self.high))
        return Part(path, first)

    def commit(self, messages) -> None:
        parts = [m.path for m in sorted((m for m in messages if m and m.first >= 0), key=lambda m: m.first)]
        counts = []
        for p in parts:
            with open(p, "rb") as f:
                counts.append(header(f.read(HEADER.size))[0])
        with open(self.path, "wb") as out:
            out.write(HEADER.pack(MAGIC, sum(counts), self.low, self.high))
            for k in range(DIMS):
                for p, n in zip(parts, counts, strict=True):
                    with open(p, "rb") as f:
                        f.seek(HEADER.size + 2 * k * n)
                        out.write(f.read(2 * n))
            labels = []
            for p, n in zip(parts, counts, strict=True):
                with open(p, "rb") as f:
                    f.seek(HEADER.size + 2 * DIMS * n)
                    labels.append(np.unpackbits(np.frombuffer(f.read(), np.uint8), bitorder="little")[:n])
            out.write(np.packbits(np.concatenate(labels) if labels else np.zeros(0, np.uint8), bitorder="little").tobytes())
        for p in parts:
            os.remove(p)

    def abort(self, messages) -> None:
        for p in glob.glob(f"{self.path}.part-*"):
            os.remove(p)


def _local(path: str) -> str:
    """A path that all executors have mounted. Raises ValueError for one of another file system: Parquet is the index there."""
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{path} isn't a local or mounted path")
    return path


class FlatIndex(DataSource):
    """spark.read.format("flat_index").load(path), frame.write.format("flat_index").mode("append").save(path); local or mounted paths."""

    @classmethod
    def name(cls) -> str:
        return "flat_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FlatIndexReader:
        return FlatIndexReader(_local(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> FlatIndexWriter:
        return FlatIndexWriter({**self.options, "path": _local(self.options["path"])})
