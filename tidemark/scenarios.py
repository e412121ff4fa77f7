"""Databases built from the test tables, for the registered queries: the events in eleven tables, and suppliers one by one."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import copy_tree
from .db import Db
from .errors import InvalidArgument
from .functions.values import F32, SQ1, UINT
from .model import CompactionPolicy, Observation, OpenOptions, Value
from .sources.frames import event_facts
from .sources.work import folder

DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01
END = START + 30 * DAY
MID = START + 15 * DAY
MICRO = 1_000_000
HOURS = 21_600  # a validity of six hours, in seconds
UNIT = 15 * DAY // 2  # what one bulk append holds
WINDOW = 15 * DAY
#: Tables of the events database: (kind, with nulls, validity in seconds).
FOREVER, SHORT, TWO, NO_SERIES, NO_FIELD, NEITHER, CLOCK, CODES, FLOATS, FULL, HEADS = range(1, 12)
TABLES = {
    FOREVER: (UINT, True, None), SHORT: (UINT, True, HOURS), TWO: (UINT, True, HOURS), NO_SERIES: (UINT, True, None), NO_FIELD: (UINT, True, None), NEITHER: (UINT, True, None),
    CLOCK: (UINT, True, 40 * HOURS), CODES: (SQ1, True, None), FLOATS: (F32, True, None), FULL: (UINT, False, None), HEADS: (UINT, True, 8 * HOURS),
}
RETIRED_SERIES, RETIRED_FIELD = START + 12 * DAY, START + 20 * DAY
OPTIONS = OpenOptions(ticks_per_second=MICRO, compaction=CompactionPolicy(WINDOW // MICRO, 100_000 * DAY // MICRO))
_built: dict[tuple[str, str], Db] = {}


def _all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, nulls in sorted({x[:2] for x in TABLES.values()}):
        tables = [t for t, x in TABLES.items() if x[:2] == (kind, nulls)]
        some = event_facts(spark, sf_dir, kind, nulls).withColumn("table_id", F.explode(F.array(*[F.lit(t).cast("long") for t in tables])))
        out = some if out is None else out.unionByName(some)
    return out.select("table_id", "series_id", "field_id", "ts", "kind", "u", "q", "f")


def events_db(spark: SparkSession, sf_dir: str) -> Db:
    """The events in eleven tables, appended in four units; built once a session and read only."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        db = Db(spark, folder(spark, "events"), OPTIONS)
        fields = {t: [(i, kind) for i in range(1, 6)] for t, (kind, _, _) in TABLES.items()}
        for t, (_, _, validity) in TABLES.items():
            assert db.create_table(fields[t], validity) == t
        facts = _all_facts(spark, sf_dir)
        for k in range(4):
            if START + k * UNIT == MID:
                db.new_table_version(TWO, fields[TWO], 8 * HOURS)
            db.append_frame(facts.where(F.col("ts").between(START + k * UNIT, START + (k + 1) * UNIT - 1)))
        for series in sorted({s for s, _ in streams(db, FOREVER) if s % 7 == 0}):
            for t in (NO_SERIES, NEITHER):
                db.retire_series(t, series, RETIRED_SERIES)
        for t in (NO_FIELD, NEITHER):
            db.retire_field(t, 2, RETIRED_FIELD)
        db.seal()
        _built[key] = db
    return _built[key]


@contextmanager
def events_copy(spark: SparkSession, sf_dir: str):
    """A copy of the events database that may be changed."""
    root = folder(spark, "copy")
    copy_tree(spark, events_db(spark, sf_dir).root, root)
    with Db(spark, root, OPTIONS) as db:
        yield db


def streams(db: Db, table: int) -> list[tuple[int, int]]:
    return sorted((r["series_id"], r["field_id"]) for r in db.snapshot().facts_upto(None, None, {table}).where(F.col("table_id") == table).select("series_id", "field_id").distinct().collect())


def keys(db: Db, table: int, repeat: int = 1) -> list[tuple[int, int, int]]:
    """Every stream of a table, ``repeat`` times in a row."""
    return [(table, s, f) for s, f in streams(db, table) for _ in range(repeat)]


def asked(db: Db, table: int, repeat: int = 1) -> DataFrame:
    """The same as a frame that never reaches the driver, with the numbers of ``named``."""
    every = db.snapshot().streams(table).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    return every.select(((F.col("series_id") * 10 + F.col("field_id")) * 10 + F.col("r")).cast("int").alias("ord"), "table_id", "series_id", "field_id")


def named(out: DataFrame, repeat: int = 1) -> DataFrame:
    """``ord`` as a number that the stream and the repetition tell."""
    return out.withColumn("ord", ((F.col("series_id") * 10 + F.col("field_id")) * 10 + F.col("ord") % repeat).cast("int"))


# --- suppliers: a dimension table, one observation a row ---

SUPPLIERS_SQL = """s AS (SELECT s_suppkey AS ts, s_nationkey::BIGINT AS series_id, CASE WHEN s_acctbal >= 0 THEN CAST(round(s_acctbal * 100) AS BIGINT) END AS u,
  row_number() OVER (ORDER BY s_suppkey) AS n, count(*) OVER () AS c FROM supplier)"""


def suppliers(spark: SparkSession, sf_dir: str) -> list[tuple[int, int, int | None]]:
    """(ts, series, value) in order of keys."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") >= 0, F.round(F.col("s_acctbal") * 100).cast("long")).alias("u"))
    return sorted(map(tuple, rows.collect()))


def observation(ts: int, series: int, u: int | None, field: int = 1) -> Observation:
    return Observation(ts, ((series, field, Value.null() if u is None else Value.uint(u)),))


def append_all(db: Db, table: int, rows, every: int = 0, then=None) -> None:
    """Appends rows in order; after every ``every`` rows, and at the end, calls ``then``."""
    for n, (ts, series, u) in enumerate(rows, 1):
        db.append(table, observation(ts, series, u))
        if every and n % every == 0:
            then()
    if every and len(rows) % every:
        then()


def rejected(call) -> bool:
    try:
        call()
    except InvalidArgument:
        return True
    return False


def small_db(spark: SparkSession, options: OpenOptions | None = None) -> Db:
    return Db(spark, folder(spark, "suppliers"), options)


def shown(facts: DataFrame) -> DataFrame:
    return facts.select("series_id", "ts", F.col("u").cast("long").alias("u"))
