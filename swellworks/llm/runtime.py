"""Shared storage, staged tables and Arrow plumbing for the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


BATCH_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Unset, a session whose only machine is this one (a local master, as in tests) gets a folder of its own; any other raises.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = os.path.join(tempfile.gettempdir(), "swellworks-shared")
    os.makedirs(local, exist_ok=True)
    return "file://" + local


def settle() -> None:
    """Give memory that a piece of work no longer needs back to the system: workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Prepare a session: bounded Arrow batches, and this package in the executors' Python unless the path has it.

    A batch of Spark's default 64 MB is held several times over on its way to Python; a smaller setting stays as it is.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    inherited = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    sc = spark.sparkContext
    if root in inherited or getattr(sc, "_swellworks_shipped", False):
        return
    folder = tempfile.mkdtemp()
    sc.addPyFile(shutil.make_archive(f"{folder}/swellworks", "zip", root, "swellworks"))
    sc._swellworks_shipped = True


def _forget(jvm, uri: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        at = jvm.org.apache.hadoop.fs.Path(uri)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


class Workspace:
    """A run's own folder below the shared root.

    ``table`` cuts lineage by writing Parquet and reading it again, so a lost executor costs no more than
    its running tasks; ``drop`` and ``reclaim`` give disk back as soon as a table or shuffle is spent.  The folder goes
    when the driver's process ends, unless ``keep`` is set (for archives or token files that are to stay).
    """

    def __init__(self, spark: SparkSession, name: str, keep: bool = False):
        ship(spark)
        self.spark, self.uri = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if not keep:
            atexit.register(_forget, spark._jvm, self.uri)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def reclaim(self) -> None:
        """Let Spark delete the shuffle files of finished queries."""
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)


def put_file(folder: str, name: str, parts: Iterable[bytes]) -> str:
    """Write a file of the shared store under its final name in one move; a retried task overwrites the same bytes."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    final, part = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    fs.move(part, final)
    return f"{folder}/{name}"


class RangeReader:
    """Reads byte ranges of files in the shared store; the last file stays open."""

    def __init__(self):
        self._uri, self._file = None, None

    def __call__(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self._uri:
            self.close()
            fs, path = pafs.FileSystem.from_uri(uri)
            self._file, self._uri = fs.open_input_file(path), uri
        self._file.seek(offset)
        return self._file.read(length)

    def size(self, uri: str) -> int:
        self(uri, 0, 0)
        return self._file.size()

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._uri = self._file = None


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def spare(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column has it, in whatever case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def extended(df: DataFrame, names: Iterable[str], more: str = "") -> StructType:
    """The columns ``names`` of df as they are, and ``more`` in DDL."""
    return StructType([df.schema[n] for n in names] + (StructType.fromDDL(more).fields if more else []))


def slices(batch: pa.RecordBatch, column: str | int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about ``limit`` bytes of ``column`` (one row at least, never part of a row)."""
    _, offs = utf8(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def map_slices(df: DataFrame, column: str, work: Callable, schema: str | StructType, limit: int = 1 << 20) -> DataFrame:
    """mapInArrow over bounded pieces: ``work(piece)`` gives a record batch, or None for nothing.

    Names with dots, which mapInArrow can't resolve, reach ``work`` as numbered ones: it should go by position.
    """
    at = df.columns.index(column)
    if any("." in c or "`" in c for c in df.columns):
        df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, at, limit):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out
            settle()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, .. of every (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
