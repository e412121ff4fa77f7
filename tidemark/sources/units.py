"""Unit files: facts sorted by stream and time, and each stream's last fact, as Parquet with delta-packed numbers."""

from __future__ import annotations

import threading

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import F32, SQ1, UINT
from ..model import FACTS, KEY, SECTION_ROWS, STORED
from .fs import Files

#: Page format 2 packs numbers as differences; a dictionary of times would only be in the way.
OPTIONS = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#ts": "false"}
LARGEST = 2**63 - 1


def stored(facts: DataFrame) -> DataFrame:
    """Facts with one number each; integers that do not fit a long go to ``big``."""
    kind, u = F.col("kind"), F.col("u").cast("decimal(20,0)")
    small = u <= F.lit(LARGEST).cast("decimal(20,0)")
    val = F.when((kind == UINT) & small, u.cast("long")).when(kind == SQ1, F.col("q").cast("long")).when(kind == F32, F.col("f").cast("long"))
    return facts.select(*[F.col(c).cast(t) for c, t in (x.split(" ") for x in STORED.split(", ")[:4])], kind.cast("tinyint").alias("kind"), val.alias("val"), F.when((kind == UINT) & ~small, u).alias("big"))


def shown(rows: DataFrame) -> DataFrame:
    """The inverse of ``stored``; filters on streams and times still reach the files."""
    kind = F.col("kind")
    return rows.select(
        *KEY, "ts", "kind", F.when(kind == UINT, F.coalesce("big", F.col("val").cast("decimal(20,0)"))).alias("u"),
        F.when(kind == SQ1, F.col("val").cast("smallint")).alias("q"), F.when(kind == F32, F.col("val")).alias("f"),
    )


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_listing = threading.Lock()


def _open(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stored rows of folders.  Spark lists many folders by a job of a task each; here a task lists its share of them."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    if len(paths) <= tasks:
        return spark.read.schema(STORED).parquet(*paths)
    with _listing:
        before = spark.conf.get(LISTING, None)
        spark.conf.set(LISTING, tasks)
        try:
            return spark.read.schema(STORED).parquet(*paths)
        finally:
            spark.conf.set(LISTING, before) if before is not None else spark.conf.unset(LISTING)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return shown(_open(spark, paths)) if paths else spark.createDataFrame([], FACTS)


def write(facts: DataFrame, path: str) -> None:
    """``path``/facts and ``path``/last.

    Facts are dealt by ranges of stream and time, so a stream that holds much of
    the unit is split too and row groups prune; a file holds at most 4 Mi facts.
    """
    spark = facts.sparkSession
    rows = stored(facts).repartitionByRange(*KEY, "ts").sortWithinPartitions(*KEY, "ts")
    rows.write.mode("overwrite").options(**OPTIONS).option("maxRecordsPerFile", SECTION_ROWS * 64).parquet(f"{path}/facts")
    newest = [F.max_by(c, "ts").alias(c) for c in ("kind", "val", "big")]
    last = spark.read.schema(STORED).parquet(f"{path}/facts").groupBy(*KEY).agg(F.max("ts").alias("ts"), *newest)
    last.select(*[c.split()[0] for c in STORED.split(", ")]).sortWithinPartitions(*KEY).write.mode("overwrite").options(**OPTIONS).parquet(f"{path}/last")


def summary(spark: SparkSession, path: str) -> dict:
    """Times, count and digest of a unit's facts, and the times of each table.

    The digest is an order-free sum of hashes of all columns, of the facts and of the streams' last facts.
    """
    return summaries(spark, [path])[path]


def summaries(spark: SparkSession, paths: list[str]) -> dict[str, dict]:
    """``summary`` of many units, whose folders differ in name, by one job for facts and one for last facts."""

    def digests(name):
        rows = _open(spark, [f"{p}/{name}" for p in paths])
        row = F.xxhash64(*rows.columns, *[F.col(c).isNull() for c in rows.columns]).cast("decimal(38,0)")  # hashes skip nulls
        rows = rows.select(F.regexp_extract("_metadata.file_path", f"([^/]+)/{name}/[^/]+$", 1).alias("unit"), "table_id", "ts", row.alias("d"))
        out = {p.rsplit("/", 1)[1]: [] for p in paths}
        for r in rows.groupBy("unit", "table_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), F.sum("d").alias("d")).collect():  # one row a unit and table
            out[r["unit"]].append((r["table_id"], r["a"], r["b"], r["n"], int(r["d"])))
        return out

    got, last = digests("facts"), digests("last")
    return {p: _summed(got[n], last[n]) for p in paths for n in [p.rsplit("/", 1)[1]]}


def _summed(got: list[tuple], last: list[tuple]) -> dict:
    """A summary from (table, first time, last time, facts, digest) of each table."""
    return {
        "min_ts": min((a for _, a, *_ in got), default=None), "max_ts": max((b for _, _, b, *_ in got), default=None), "facts": sum(n for *_, n, _ in got),
        "digest": str(sum(d for *_, d in got)), "last_digest": str(sum(d for *_, d in last)), "tables": {str(t): [a, b] for t, a, b, *_ in sorted(got)},
    }


# --- few facts that the driver holds anyway: the same files and digests without a job ---

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
PARQUET = pa.schema([("table_id", pa.int64()), ("series_id", pa.int64()), ("field_id", pa.int32()), ("ts", pa.int64()), ("kind", pa.int8()), ("val", pa.int64()), ("big", pa.decimal128(20, 0))])


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _hash(seed: np.ndarray, values: np.ndarray, wide: bool) -> np.ndarray:
    """Spark's xxhash64 of a column of longs, or of ints and booleans, on top of ``seed``."""
    v = values.astype(np.int64).view(np.uint64)
    if wide:
        h = _turn(seed + P5 + np.uint64(8) ^ _turn(v * P2, 31) * P1, 27) * P1 + P4
    else:
        h = _turn(seed + P5 + np.uint64(4) ^ (v & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)


def _digests(rows: list[tuple]) -> list[int]:
    """The hash of each stored row, as ``summary`` has it."""
    h = np.full(len(rows), 42, np.uint64)
    columns = list(zip(*rows))
    for k, column in enumerate(columns):
        none = np.array([x is None for x in column])
        if not none.all():
            h = np.where(none, h, _hash(h, np.array([0 if x is None else x for x in column], np.int64), pa.types.is_int64(PARQUET.types[k])))
    for column in columns:
        h = _hash(h, np.array([x is None for x in column], np.int64), False)
    return h.view(np.int64).tolist()


def write_few(files: Files, path: str, tail: list[tuple]) -> dict | None:
    """Writes rows of ``FACTS`` as ``write`` does and returns their summary and ``bytes``; None if a number is too large for a long."""
    if any(r[4] == UINT and r[5] > LARGEST for r in tail):
        return None
    rows = sorted((*r[:5], {UINT: r[5] if r[5] is None else int(r[5]), SQ1: r[6], F32: r[7]}.get(r[4]), None) for r in tail)
    newest = list({r[:3]: r for r in rows}.values())
    parts, size = [], 0
    for name, some in (("facts", rows), ("last", newest)):
        sink = pa.BufferOutputStream()
        table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), PARQUET.types)], schema=PARQUET)
        pq.write_table(table, sink, compression="zstd", data_page_version="2.0", use_dictionary=[c for c in PARQUET.names if c != "ts"])
        data, file = sink.getvalue().to_pybytes(), f"{path}/{name}/part-00000.zstd.parquet"
        if not files.create(file, data):  # left by a writer that died
            files.delete(path)
            return write_few(files, path, tail)
        size += len(data)
        tables: dict[int, list] = {}
        for r, d in zip(some, _digests(some)):
            t = tables.setdefault(r[0], [r[3], r[3], 0, 0])
            t[:] = min(t[0], r[3]), max(t[1], r[3]), t[2] + 1, t[3] + d
        parts.append([(k, *v) for k, v in tables.items()])
    return {"bytes": size} | _summed(*parts)
