"""Shared helpers: intermediate tables in the shared folder, column access, Arrow slices."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` if the session has it.

    Only where neither that setting nor a checkpoint directory exists and all runs in one process (local tests) a fresh
    temporary folder is set. On a cluster, where machines do not share such folders, this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrove-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives the system back what is free, but held by the allocators: a Python worker stays while others, and the JVM, need memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a map of batches, that holds no free memory when it ends."""

    @functools.wraps(run)
    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return then_release


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_column(name: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns _c0, _c1, ... and the new name of each old one: no name clashes with an operator's own."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(id_col: str = "doc_id", modulus: int = 7) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(col(id_col).cast("string").cast("binary")) % modulus


def slices(array: pa.StringArray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts hold about ``most`` bytes at the most; a longer text is alone in its range."""
    import numpy as np

    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int32, n + 1, array.offset * 4).astype(np.int64)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def string_array(column: pa.Array) -> pa.StringArray:
    """The column as one utf8 array with 32-bit offsets and without nulls (null: empty)."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(array: pa.StringArray) -> tuple:
    """(bytes as uint8 array, offsets from 0) of an utf8 array."""
    import numpy as np

    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], np.int32, n + 1, array.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    data = array.buffers()[2]
    lo, hi = int(offsets[0]), int(offsets[-1])
    buffer = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return buffer, offsets - lo
