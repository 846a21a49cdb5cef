"""Shared helpers of the training-data operators: scratch tables, row keys, word rules."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space as bytes, for the Arrow-side code.
SPACE = b" \t\n\x0b\x0c\r"

#: Bytes of an Arrow batch on its way to Python workers. Texts are long, and a task holds several batches.
ARROW_BYTES = "4m"

_local_root: str | None = None


def bounded_batches(spark: SparkSession) -> None:
    """Sets the bytes of an Arrow batch for the session, unless the session sets them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BYTES)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir`` of the session.

    Only a plain local session (tests) without that setting gets a temporary folder; a cluster
    without it is an error, since executors do not share a machine-local folder.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


class Scratch:
    """Written tables that cut lineage; they live in the shared folder, so a lost executor loses nothing.

    A result may read them until it is written, so they stay until ``free`` or ``free_since``.
    """

    #: Folders of this process, in the order they were made.
    made: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/quillon/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        Scratch.made.append(self.base)

    @staticmethod
    def free_since(spark: SparkSession, mark: int) -> None:
        """Deletes the folders made after the first ``mark``, once nothing reads them any more."""
        gone, Scratch.made[mark:] = Scratch.made[mark:], []
        for base in gone:
            _delete(spark, base)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quillon_path = path
        return out

    def sparkframe(self, rows: list, kinds: str) -> DataFrame:
        """A DataFrame of a few rows that the driver made."""
        return self.spark.createDataFrame(rows, kinds)

    def free(self, df: DataFrame) -> None:
        path = getattr(df, "_quillon_path", None)
        if path:
            _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library: it keeps its own counsel
        return lambda _: 0


def lean(run):
    """``run`` over the batches of a task; at its end the worker gives back memory that is free."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trimmer()(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string, tkey long): the only columns an operator works on.

    Selecting first keeps extra columns, whatever their names, out of the operator. ``tkey`` tells
    apart rows that share a doc_id but not a text.
    """
    return docs.select(
        named(id_col).cast("long").alias("doc_id"),
        named(text_col).cast("string").alias("text"),
        F.xxhash64(named(text_col).cast("string")).alias("tkey"),
    )


def row_slices(texts_bytes: list[int], limit: int = 8 << 20):
    """(start, stop) slices of a batch whose texts hold about ``limit`` bytes each."""
    start, size = 0, 0
    for i, n in enumerate(texts_bytes):
        size += n
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts_bytes):
        yield start, len(texts_bytes)
