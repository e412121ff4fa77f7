"""Shared plumbing: the shared work folder, Arrow text views, semi-join reduction."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import shared_folder, ship_package

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ARROW_BYTES = str(8 << 20)
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Work:
    """A private subfolder of the shared folder for written intermediate tables.

    ``save`` cuts lineage with a written table, so a lost executor costs at most
    the running stage; shuffle files of the finished write are freed at once.
    ``drop`` removes a table that nothing reads any more.  What remains goes
    when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship_package(spark)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)  # workers hold a few batches
        self.root = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []
        atexit.register(self._clear)

    def _clear(self) -> None:
        try:
            for table in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            _remove(self.spark, self.root)
        except Exception:  # the session may be gone at exit
            pass

    def save(self, df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
        """Writes ``df`` and reads it again; ``tasks`` is for tables known to be small, which would be written in many tiny files."""
        path = f"{self.root}/{name}"
        df = df if tasks is None else df.coalesce(tasks)
        self._write(lambda: df.write.option("compression", "zstd").parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
        """``df`` written in n buckets of ``key``: what is dealt by ``key`` to n partitions joins it without moving it."""
        table = f"tidemark_{uuid.uuid4().hex}"
        self.tables.append(table)
        self._write(lambda: df.repartition(n, key).write.option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(n, key).saveAsTable(table))
        return self.spark.table(table)

    def _write(self, run) -> None:
        conf, old = self.spark.conf, self.spark.conf.get(FILE_CLEANUP)
        conf.set(FILE_CLEANUP, "true")
        try:
            run()
        finally:
            conf.set(FILE_CLEANUP, old)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(rows: int, each: int = 20_000) -> int:
    """Tasks for a table of a known number of rows: more with more rows, without bound."""
    return max(8, rows // each)


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Marks a table of a known number of rows for broadcast, unless there are too many."""
    return F.broadcast(df) if rows <= most else df


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``count`` how many of ``rows`` have it.

    Keys of more than a small part of all rows are broadcast, the others are
    shuffled, so no key fills a task.  At most 2 rows a partition are broadcast,
    whatever the input.  Both sides may be read twice; give written tables.  ``how`` is inner or left.
    """
    total, most = table.agg(F.sum(count), F.max(count)).first()
    limit = max(64, (total or 0) // (2 * parts(rows.sparkSession)))
    if (most or 0) <= limit:
        return rows.join(table.drop(count), on, how)
    hot = F.broadcast(table.where(F.col(count) > limit).drop(count))
    cold = table.where(F.col(count) <= limit).drop(count)
    near = rows.join(hot, on)
    return near.unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on, how))


def semi_reduce(df: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """Rows of ``df`` whose ``column`` may occur in the one column of ``ids``.

    A Bloom-type map of fixed size (``bits`` bits in at most ``bits / 64`` rows,
    which bounds the broadcast whatever the input) drops most other rows before
    they are shuffled.  It keeps a superset; callers still join exactly.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = (
        ids.select(slot(F.col(ids.columns[0])).alias("_slot"))
        .groupBy((F.col("_slot") / 64).cast("int").alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot % 64 as int))")).alias("_mask"))
    )
    out = df.withColumn("_slot", slot(F.col(column))).withColumn("_word", (F.col("_slot") / 64).cast("int"))
    return out.join(F.broadcast(words), "_word").where("getbit(_mask, cast(_slot % 64 as int)) = 1").select(*df.columns)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets of its rows, without a copy."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def tidy() -> None:
    """Gives freed memory of a worker back to the system between pieces of work."""
    pa.default_memory_pool().release_unused()
    if not _libc:
        import ctypes

        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library
            _libc.append(lambda _: 0)
    _libc[0](0)


_libc: list = []


def slices(batches, column: int, most: int = 1 << 20):
    """Record batches cut so that one piece holds about ``most`` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    tidy()


def binary_column(blob: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array from one buffer and n + 1 byte offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(blob)])


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
