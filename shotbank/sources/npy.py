"""Vectors in numpy's ``.npy`` files, and their metadata in a JSON array: the stored form of other tools.

``NpySource`` is a Python data source (``spark.read.format("npy")``): a file's header tells where each row lies, so a
partition is a range of rows and one large file is read by many tasks. A folder holds parts whose rows
follow one another in the order of the names. The writer leaves one part per task, named when the job commits.

Files are opened with ``pyarrow.fs`` (local and shared folders, and the object stores it knows).
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from shotbank.session import ship_package

#: Bytes of a file that one partition reads, and rows in an Arrow batch.
RANGE_BYTES = 64 << 20
BATCH_ROWS = 10_000
_MAGIC = b"\x93NUMPY"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


@dataclass(frozen=True)
class Header:
    dtype: str
    rows: int
    width: int
    start: int


def read_header(f) -> Header:
    """What the header of a two-dimensional, row-major array of floats says."""
    if f.read(6) != _MAGIC:
        raise ValueError("not a .npy file")
    major, _ = f.read(2)
    size, = struct.unpack("<H" if major == 1 else "<I", f.read(2 if major == 1 else 4))
    import ast

    said = ast.literal_eval(f.read(size).decode("latin-1" if major < 3 else "utf-8"))
    shape, dtype = said["shape"], np.dtype(said["descr"])
    if len(shape) != 2 or said["fortran_order"] or dtype.kind != "f":
        raise ValueError(f"not rows of floats: {said}")
    return Header(dtype.str, int(shape[0]), int(shape[1]), f.tell())


@dataclass
class Rows(InputPartition):
    path: str
    header: Header
    first: int
    upto: int
    pos: int


class NpySource(DataSource):
    """Options ``path`` (a file or a folder of parts) and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "pos long, embedding array<float>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Rows]:
        fs, path = file_system(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no vectors at {self.path}")
        files = [path] if info.is_file else sorted(
            f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".npy") and not posixpath.basename(f.path).startswith(("_", ".")))
        out, pos = [], 0
        for name in files:
            with fs.open_input_file(name) as f:
                h = read_header(f)
            step = max(1, self.range_bytes // max(1, h.width * np.dtype(h.dtype).itemsize))
            for lo in range(0, h.rows, step):
                out.append(Rows(name, h, lo, min(h.rows, lo + step), pos + lo))
            pos += h.rows
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        h = partition.header
        row = h.width * np.dtype(h.dtype).itemsize
        with fs.open_input_file(partition.path) as f:
            for lo in range(partition.first, partition.upto, BATCH_ROWS):
                n = min(partition.upto, lo + BATCH_ROWS) - lo
                f.seek(h.start + lo * row)
                m = np.frombuffer(f.read(n * row), h.dtype).astype(np.float32)
                if len(m) != n * h.width:
                    raise ValueError(f"{partition.path} ends before row {lo + n}")
                pos = partition.pos + lo - partition.first
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * h.width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(pos, pos + n)), pa.ListArray.from_arrays(ends, pa.array(m))],
                                                 names=["pos", "embedding"])


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """The vectors of a task as one part; its length is known at the end, so the header's space is kept and filled last."""
        task = TaskContext.get()
        fs, path = file_system(self.path)
        fs.create_dir(f"{path}/_parts")
        name = f"{path}/_parts/{task.partitionId():06d}-{task.taskAttemptId()}.npy"
        held: list[np.ndarray] = []
        for batch in iterator:
            col = batch.column(batch.schema.names.index("embedding"))
            if col.null_count:
                raise ValueError("a vector is null")
            if len(col):
                width = len(col[0])
                if (np.diff(col.offsets.to_numpy()) != width).any() or (held and held[0].shape[1] != width):
                    raise ValueError("vector dimensions differ")
                held.append(col.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, width))
        rows = sum(len(m) for m in held)
        if not rows:
            return Part(task.partitionId(), "")
        head = repr({"descr": "<f4", "fortran_order": False, "shape": (rows, held[0].shape[1])}).encode() + b"\n"
        head = head[:-1] + b" " * (-(len(head) + 10) % 64) + b"\n"
        with fs.open_output_stream(name) as f:
            f.write(_MAGIC + b"\x01\x00" + struct.pack("<H", len(head)) + head)
            for m in held:
                f.write(m.tobytes())
        return Part(task.partitionId(), name)

    def commit(self, messages: list) -> None:
        fs, path = file_system(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
                if f.is_file and f.path.endswith(".npy"):
                    fs.delete_file(f.path)
        for m in sorted((m for m in messages if m and m.path), key=lambda m: m.number):
            fs.move(m.path, f"{path}/part-{m.number:06d}.npy")
        fs.delete_dir(f"{path}/_parts")

    def abort(self, messages: list) -> None:
        fs, path = file_system(self.path)
        if fs.get_file_info(f"{path}/_parts").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/_parts")


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(NpySource)


def load_npy(spark: SparkSession, path: str, metadata: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(pos, embedding) of a ``.npy`` file or folder of parts; with ``metadata``, a JSON array of one object per row, its
    fields beside them. ``FileNotFoundError`` if either is not there; a different number of objects and rows is an error."""
    register(spark)
    vectors = spark.read.format("npy").option("path", path).option("rangeBytes", str(range_bytes)).load()
    if metadata is None:
        return vectors
    fs, name = file_system(metadata)
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no metadata at {metadata}")
    # one array in one file: one task reads it, in order
    fields = spark.read.option("multiLine", "true").json(metadata).withColumn("pos", F.monotonically_increasing_id())
    n, m = fields.count(), vectors.count()
    if n != m:
        raise ValueError(f"{m} vectors, but {n} metadata entries")
    return vectors.join(fields, "pos")


def save_npy(vectors: DataFrame, path: str, order_by: str, vec: str = "embedding", parts: int | None = None) -> int:
    """Write the vectors in the order of ``order_by`` as parts under ``path``; returns how many were written."""
    register(vectors.sparkSession)
    by = vectors.select(order_by, F.col(vec).cast("array<float>").alias("embedding"))
    by = (by.repartitionByRange(parts, order_by) if parts else by.repartitionByRange(order_by)).sortWithinPartitions(order_by)
    by.select("embedding").write.format("npy").option("path", path).mode("overwrite").save()
    return load_npy(vectors.sparkSession, path).count()
