"""Registered queries, each with the SQL that a database would run.

Queries on facts, catalogue, lifecycle and archive go through ``Db`` and its
snapshots: the events table in bulk (``scenarios.events_db``), and the suppliers,
a dimension table, one observation at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import cli
from . import scenarios as x
from .archive import ArchiveCursor, ArchiveDb, ExportChunk, Namespace, RestoreBuilder
from .db import Db
from .errors import TidemarkError
from .functions import codec
from .functions.values import F32, SQ1, UINT, cell_text, f32_order, f32_value, sq1_fp4
from .model import Observation, OpenOptions, SyncPolicy, Value
from .plans import lifecycle
from .scenarios import CLOCK, CODES, DAY, END, FLOATS, FOREVER, FULL, HEADS, HOURS, MICRO, MID, NEITHER, NO_FIELD, NO_SERIES, SHORT, START, SUPPLIERS_SQL, TWO, UNIT, WINDOW
from .sources import units
from .sources.frames import event_facts
from .sources.workload import lerp, splitmix
from .sources.work import folder
from .streaming.ingest import stream_into

AT = START + 20 * DAY + 43_200_000_000
SECTION = 10 * DAY
KINDS = {UINT: FOREVER, SQ1: CODES, F32: FLOATS}
#: Versions as SQL sees them: (from, to, validity in seconds).
ALWAYS = -(2**62)
LIVE, HOURLY, CHANGED = [(ALWAYS, None, None)], [(ALWAYS, None, HOURS)], [(ALWAYS, MID, HOURS), (MID, None, 8 * HOURS)]


def _facts_sql(kind: int = UINT, nulls: bool = True) -> str:
    value = {
        UINT: "CAST(round(value * 100) AS BIGINT)",
        SQ1: """CAST(least(CASE WHEN b <= 500 THEN (b + 5) // 10 WHEN b <= 1200 THEN 50 + (b - 500 + 12) // 25 ELSE 78 + (b - 1200 + 25) // 50 END, 254) AS BIGINT)""",
        F32: "CAST(value AS FLOAT)",
    }[kind]
    return f"""f AS (SELECT 1::BIGINT AS table_id, user_id AS series_id, event_id,
      CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS field_id,
      epoch_us(ts) AS ts, CASE WHEN {'event_id % 11 = 0' if nulls else 'false'} THEN 0 ELSE {kind} END AS kind,
      CASE WHEN {'event_id % 11 <> 0' if nulls else 'true'} THEN {value} END AS v
      FROM (SELECT *, least(CAST(floor(value * 20) AS BIGINT), 10000) AS b FROM events))"""


# --- aggregate ---


def _agg(spark, sf_dir, kind=UINT, start=START, end=END, width=DAY, repeat=1, nulls=True):
    db, table = x.events_db(spark, sf_dir), KINDS[kind] if nulls else FULL
    out = db.snapshot().aggregate(x.asked(db, table, repeat), start, end, width)
    low, high = {UINT: ("min_u", "max_u"), SQ1: ("min_q", "max_q"), F32: ("min_f", "max_f")}[kind]
    show = (lambda c: f32_value(F.col(c)).cast("double")) if kind == F32 else (lambda c: F.col(c).cast("long"))
    return out.select(
        "ord", "series_id", "field_id", "start_ts", "end_ts", "sample_count", F.col("null_count").cast("long").alias("null_count"),
        show(low).alias("low"), show(high).alias("high"), F.col("sum").cast("long").alias("total"), "is_partial",
    )


def _agg_sql(kind=UINT, start=START, end=END, width=DAY, repeat=1, nulls=True) -> str:
    number = {UINT: "v", SQ1: "CASE WHEN v <= 50 THEN v * 1000 WHEN v <= 78 THEN 50000 + (v - 50) * 2500 ELSE 120000 + (v - 78) * 5000 END", F32: "NULL"}[kind]
    total = "CAST(NULL AS BIGINT)" if kind == F32 else f"CAST(coalesce(sum({number}), 0) AS BIGINT)"
    shown = "DOUBLE" if kind == F32 else "BIGINT"
    return f"""WITH {_facts_sql(kind, nulls)}, c AS (SELECT max(ts) AS last_ts FROM f)
      SELECT CAST((series_id * 10 + field_id) * 10 + r AS INTEGER) AS ord, series_id, CAST(field_id AS INTEGER) AS field_id, {start} + b * {width} AS start_ts,
        least({start} + (b + 1) * {width}, {end}) AS end_ts, count(*) AS sample_count, count(*) - count(v) AS null_count,
        CAST(min(v) AS {shown}) AS low, CAST(max(v) AS {shown}) AS high, {total} AS total,
        {start} + (b + 1) * {width} > {end} OR (SELECT last_ts FROM c) < least({start} + (b + 1) * {width}, {end}) AS is_partial
      FROM (SELECT *, (ts - {start}) // {width} AS b FROM f WHERE ts >= {start} AND ts < {end}), range({repeat}) AS x(r)
      GROUP BY series_id, field_id, b, r"""


# --- lookups ---


def _shown(out: DataFrame, repeat: int = 1) -> DataFrame:
    return x.named(out, repeat).select("ord", "series_id", "field_id", "state", F.col("u").cast("long").alias("u"), "at_ts")


def _value_at(spark, sf_dir, table=FOREVER, repeat=1, t=AT):
    db = x.events_db(spark, sf_dir)
    return _shown(db.snapshot().value_at(x.keys(db, table, repeat), t), repeat)


def _validity_sql(versions, at="p.ts") -> str:
    """Validity in ticks of the version active at a fact; null for ever."""
    cases = " ".join(f"WHEN {at} >= {a} AND {'true' if b is None else f'{at} < {b}'} THEN {'NULL' if v is None else v * MICRO}" for a, b, v in versions)
    return f"(CASE {cases} END)"


def _live_sql(t: str, versions, series=False, fields=False) -> str:
    cut = []
    if series:
        cut.append(f"CASE WHEN p.series_id % 7 = 0 THEN {START + 12 * DAY} END")
    if fields:
        cut.append(f"CASE WHEN p.field_id = 2 THEN {START + 20 * DAY} END")
    gone = f"AND NOT coalesce({t} > greatest({', '.join(cut)}) AND p.ts <= greatest({', '.join(cut)}), false)" if cut else ""
    v = _validity_sql(versions)
    return f"p.ts IS NOT NULL AND ({v} IS NULL OR {t} - p.ts < {v}) {gone}"


def _value_at_sql(versions=LIVE, repeat=1, series=False, fields=False, t=AT) -> str:
    live = _live_sql(str(t), versions, series, fields)
    return f"""WITH {_facts_sql()}, k AS (SELECT DISTINCT series_id, field_id FROM f),
      p AS (SELECT * FROM f WHERE ts <= {t} QUALIFY row_number() OVER (PARTITION BY series_id, field_id ORDER BY ts DESC) = 1),
      s AS (SELECT p.*, {live} AS live FROM p)
      SELECT CAST((k.series_id * 10 + k.field_id) * 10 + r AS INTEGER) AS ord, k.series_id, CAST(k.field_id AS INTEGER) AS field_id,
        CASE WHEN NOT coalesce(live, false) THEN 'missing' WHEN kind = 0 THEN 'null' ELSE 'value' END AS state,
        CASE WHEN live THEN v END AS u, CASE WHEN live THEN s.ts END AS at_ts
      FROM k LEFT JOIN s USING (series_id, field_id), range({repeat}) AS x(r)"""


def latest_table_clock(spark, sf_dir):
    db = x.events_db(spark, sf_dir)
    return _shown(db.snapshot().latest(x.keys(db, CLOCK)))


# --- sample ---


def _sample(spark, sf_dir, table=FOREVER, step=DAY):
    db = x.events_db(spark, sf_dir)
    out = db.snapshot().sample(x.asked(db, table), START, END, step)
    return out.select("ord", "series_id", "field_id", "slot_ts", "state", F.col("u").cast("long").alias("u"), "source_ts", "carried")


def _sample_sql(versions=LIVE, step=DAY) -> str:
    live = _live_sql("g.t", versions)
    return f"""WITH {_facts_sql()}, g AS (SELECT * FROM (SELECT DISTINCT series_id, field_id FROM f), (SELECT unnest(range({START}, {END}, {step})) AS t)),
      s AS (SELECT g.series_id, g.field_id, g.t, p.kind, p.v, p.ts, {live} AS live FROM g ASOF LEFT JOIN f p ON g.series_id = p.series_id AND g.field_id = p.field_id AND g.t >= p.ts)
      SELECT CAST((series_id * 10 + field_id) * 10 AS INTEGER) AS ord, series_id, CAST(field_id AS INTEGER) AS field_id, t AS slot_ts,
        CASE WHEN NOT coalesce(live, false) THEN 'gap' WHEN kind = 0 THEN 'null' ELSE 'value' END AS state,
        CASE WHEN live THEN v END AS u, CASE WHEN live THEN ts END AS source_ts, CASE WHEN live THEN ts < t END AS carried FROM s"""


# --- scans and metadata ---


def _scan(spark, sf_dir, start, end):
    """One stream, as the operator is defined."""
    out = x.events_db(spark, sf_dir).snapshot().scan((FOREVER, 3, 5), start, end)
    return out.select(F.lit(3).cast("long").alias("series_id"), F.lit(5).alias("field_id"), "ts", F.col("kind").cast("int").alias("kind"), F.col("u").cast("long").alias("u"))


def _scan_sql(start, end) -> str:
    return f"""WITH {_facts_sql()} SELECT series_id, CAST(field_id AS INTEGER) AS field_id, ts, CAST(kind AS INTEGER) AS kind, v AS u
      FROM f WHERE series_id = 3 AND field_id = 5 AND ts >= {start} AND ts < {end}"""


def cli_scan_rows(spark, sf_dir):
    """All facts as the command line prints them."""
    f = x.events_db(spark, sf_dir).snapshot().facts(tables={FOREVER}).where(F.col("table_id") == FOREVER)
    return f.select(F.concat_ws("\t", F.col("ts").cast("string"), cell_text(F.col("kind"), F.col("u"), F.col("q"), F.col("f"))).alias("line"))


def table_last_ts(spark, sf_dir):
    view = x.events_db(spark, sf_dir).snapshot()
    return spark.createDataFrame([(FOREVER, view.table_last_timestamp(FOREVER))], "table_id long, last_ts long")


def table_versions(spark, sf_dir):
    """A version takes effect with the first fact under it; the second was made at the middle of the range."""
    v = x.events_db(spark, sf_dir).snapshot().table_versions(TWO)
    return spark.createDataFrame([(i.version_no, i.effective_from, i.validity_s, len(i.fields)) for i in v], "version_no int, effective_from long, validity_s long, fields int")


# --- ingest ---


def ingest_validate_schema(spark, sf_dir):
    """How many rows of each field a schema of fields 1 to 4, field 4 a float, would reject, and why."""
    f = event_facts(spark, sf_dir)
    schema = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 3)], "table_id long, field_id int, value_type int")
    return lifecycle.schema_violations(f, schema).groupBy("field_id", "reason").agg(F.count("*").alias("rows"))


def _totals(facts: DataFrame) -> DataFrame:
    return facts.groupBy("table_id").agg(
        F.count("*").alias("facts"), F.sum(F.col("u").cast("long")).alias("total"), F.sum(F.col("ts") % 1_000_003).alias("clock"), F.count_if(F.col("kind") == 0).cast("long").alias("nulls")
    )


def stream_ingest(spark, sf_dir):
    """The events streamed into a database in two runs of one query."""
    root = folder(spark, "stream")
    facts = event_facts(spark, sf_dir).select("table_id", "series_id", "field_id", "ts", "kind", "u", "q", "f")
    with Db(spark, f"{root}/db", x.OPTIONS) as db:
        db.create_table([(i, UINT) for i in range(1, 6)])
        for part in (F.col("ts") < MID, F.col("ts") >= MID):
            facts.where(part).write.mode("append").parquet(f"{root}/in")
            stream_into(spark.readStream.schema(facts.schema).parquet(f"{root}/in"), db, f"{root}/checkpoint").awaitTermination()
        return _totals(db.snapshot().facts())


def append_replay(spark, sf_dir):
    """Suppliers appended one by one and synced; a new handle replays the log."""
    with x.small_db(spark) as db:
        x.append_all(db, db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir))
        root = db.root
    with Db(spark, root) as db:
        replayed, repairs = db.report.replayed_records, db.report.tail_repairs
        return x.shown(db.snapshot().facts()).withColumn("replayed", F.lit(replayed).cast("long")).withColumn("repairs", F.lit(repairs).cast("long"))


def append_rejections(spark, sf_dir):
    """Times that go back are refused and take no sequence number."""
    with x.small_db(spark) as db:
        t, out = db.create_table([(1, UINT)]), []
        for ts, series, u in x.suppliers(spark, sf_dir):
            before = db.visible_seq
            bad = x.rejected(lambda: db.append(t, x.observation(ts * 7 % 101, series, u)))
            out.append((ts, bad, db.visible_seq - before))
        return spark.createDataFrame(out, "supplier long, rejected boolean, taken long")


def append_batches(spark, sf_dir):
    """Batches of five are taken whole or not at all; every third one runs backwards."""
    with x.small_db(spark) as db:
        t, rows = db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir)
        for k in range(0, len(rows), 5):
            batch = [x.observation(*r) for r in rows[k : k + 5]]
            x.rejected(lambda: db.try_append_batch(t, batch[::-1] if k // 5 % 3 == 2 and len(batch) > 1 else batch))
        db.seal()
        return x.shown(db.snapshot().facts())


def sync_positions(spark, sf_dir):
    """The durable sequence number after every fourth supplier; creating the table took the first."""
    with x.small_db(spark) as db:
        out = []
        x.append_all(db, db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir), 4, lambda: out.append((db.visible_seq, db.sync().seq, db.maintenance_status().unsynced_records)))
        return spark.createDataFrame(out, "visible long, durable long, unsynced long")


def append_growth(spark, sf_dir):
    with x.small_db(spark) as db:
        t, rows = db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir)
        told = sum(db.estimated_append_growth(x.observation(*r)) for r in rows)
        x.append_all(db, t, rows)
        return spark.createDataFrame([(told, db.maintenance_status().tail_bytes, told <= db.tail_limit_bytes())], "told long, tail_bytes long, fits boolean")


# --- catalogue changes ---


def create_and_drop_tables(spark, sf_dir):
    """Every nation of a supplier has a table; every second one is dropped; ids are not used again; an older view keeps all."""
    with x.small_db(spark) as db:
        rows = x.suppliers(spark, sf_dir)
        tables = {s: db.create_table([(1, UINT)]) for s in sorted({s for _, s, _ in rows})}
        for ts, series, u in rows:
            db.append(tables[series], x.observation(ts, series, u))
        db.seal()
        old = db.snapshot()
        for t in list(tables.values())[1::2]:
            db.drop_table(t)
        fresh = db.create_table([])
        count = lambda v: v.facts().groupBy("table_id", "series_id").agg(F.count("*").alias("n"))
        now = count(db.snapshot()).select("table_id", "series_id", F.col("n").alias("now"))
        return count(old).join(now, ["table_id", "series_id"], "left").withColumn("fresh", F.lit(fresh).cast("long"))


def new_version(spark, sf_dir):
    """A second version with one more field, made half way, takes effect with the next supplier."""
    with x.small_db(spark) as db:
        t, rows = db.create_table([(1, UINT)], 5), x.suppliers(spark, sf_dir)
        half = (len(rows) + 1) // 2
        x.append_all(db, t, rows[:half])
        db.new_table_version(t, [(1, UINT), (2, UINT)], 9)
        early = x.rejected(lambda: db.new_table_version(t, [(1, UINT), (2, UINT)]))
        for r in rows[half:]:
            db.append(t, x.observation(*r, field=2))
        out = [(v.version_no, v.effective_from, v.validity_s, len(v.fields), early) for v in db.snapshot().table_versions(t)]
        return spark.createDataFrame(out, "version_no int, effective_from long, validity_s long, fields int, refused boolean")


def _retired(spark, sf_dir, field: bool):
    """Retired half way; newer data of a series, or of the field, revive it for good."""
    with x.small_db(spark) as db:
        t, rows = db.create_table([(1, UINT), (2, UINT)]), x.suppliers(spark, sf_dir)
        half = (len(rows) + 1) // 2
        x.append_all(db, t, rows[:half])
        series = sorted({s for _, s, _ in rows})
        if field:
            db.retire_field(t, 1, rows[half - 1][0])
        else:
            for s in series:
                db.retire_series(t, s, rows[half - 1][0])
        for r in rows[half:]:
            db.append(t, x.observation(*r, field=2))
        out = db.snapshot().value_at([(t, s, 1) for s in series], rows[-1][0] + 1)
        return out.select("series_id", "state", F.col("u").cast("long").alias("u"), "at_ts")


# --- lifecycle ---


def seal_units(spark, sf_dir):
    """A unit of level 0 for every four suppliers."""
    with x.small_db(spark) as db:
        x.append_all(db, db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir), 4, db.seal)
        return db.units_frame().drop("bytes")


def compact_reports(spark, sf_dir):
    """Units of four suppliers become one of level 1, which level 1 alone leaves as it is."""
    with x.small_db(spark) as db:
        x.append_all(db, db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir), 4, db.seal)
        one, two = db.compact(0), db.compact(1)
        db.verify()
        return db.units_frame().select("level", "min_ts", "max_ts", "facts", F.lit(one.input_units).alias("inputs"), F.lit(two.input_units).alias("more"))


def deferred_gc(spark, sf_dir):
    """Replaced unit folders stay while a snapshot reads them."""
    with x.small_db(spark) as db:
        x.append_all(db, db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir), 4, db.seal)
        view, before = db.snapshot(), len(db.files.list("units"))
        db.compact(0)
        held, facts = len(db.files.list("units")), view.facts().count()
        del view
        db._cached = None
        db._collect()
        return spark.createDataFrame([(before, held, facts, len(db.files.list("units")))], "before long, held long, facts long, after long")


def maintenance_status(spark, sf_dir):
    with x.small_db(spark, OpenOptions(SyncPolicy(3600, 1 << 30))) as db:
        t, rows = db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir)
        x.append_all(db, t, rows[:4])
        db.seal()
        x.append_all(db, t, rows[4:])
        s = db.maintenance_status()
        return spark.createDataFrame(
            [(s.pending_records, s.unsynced_records, s.visible_seq, s.durable_seq, s.level_units[0], s.sync_due, s.seal_due, s.wal_bytes, s.retention_floor)],
            "pending long, unsynced long, visible long, durable long, level0 long, sync_due boolean, seal_due boolean, wal_bytes long, floor long",
        )


def takeover(spark, sf_dir):
    """A second handle is refused, or takes over what was synced; the first can publish no more."""
    first = x.small_db(spark)
    rows = x.suppliers(spark, sf_dir)
    x.append_all(first, first.create_table([(1, UINT)]), rows)
    first.sync()
    refused = x.rejected(lambda: Db(spark, first.root))
    with Db(spark, first.root, OpenOptions(takeover=True)) as second:
        second.seal()
        stopped, epoch = x.rejected(first.seal), second.state["writer_epoch"]
        return x.shown(second.snapshot().facts()).select("ts", F.lit(refused).alias("refused"), F.lit(stopped).alias("stopped"), F.lit(epoch).cast("long").alias("epoch"))


def units_zone_map(spark, sf_dir):
    return x.events_db(spark, sf_dir).units_frame().select("unit_id", "min_ts", "max_ts", "facts")


def unit_verify(spark, sf_dir):
    """What the files of each unit hold, table by table, where ``verify`` accepts them."""
    db = x.events_db(spark, sf_dir)
    checked, out = db.verify(), None
    for u in db.state["units"]:  # some units
        rows = units.read(spark, [db.files.full(f"{u['path']}/facts")]).groupBy("table_id").agg(F.count("*").alias("facts"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
        rows = rows.withColumn("unit_id", F.lit(u["id"]).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("checked", F.lit(checked).cast("long"))


def compact_preserves_facts(spark, sf_dir):
    """Count and checksums of a table's facts after joining all units."""
    with x.events_copy(spark, sf_dir) as db:
        db.compact(0)
        return _totals(db.snapshot().facts(tables={FOREVER}).where(F.col("table_id") == FOREVER)).withColumn("units", F.lit(len(db.state["units"])))


def closed_window_selection(spark, sf_dir):
    """Units after all closed windows of 15 days are compacted."""
    with x.events_copy(spark, sf_dir) as db:
        while db.maintain().more_due:
            pass
        return db.units_frame().select("level", "min_ts", "max_ts", "facts")


def retain_heads(spark, sf_dir):
    with x.events_copy(spark, sf_dir) as db:
        db.retain(MID)
        heads = db.snapshot().heads().where(F.col("table_id") == HEADS)
        return heads.select("series_id", "field_id", "ts", F.col("kind").cast("int").alias("kind"), F.col("u").cast("long").alias("u"))


def retention_floor(spark, sf_dir):
    with x.events_copy(spark, sf_dir) as db:
        report = db.retain(MID)
        return spark.createDataFrame([(db.snapshot().retention_floor(), report.removed_units)], "floor long, removed_units long")


def _retain_then_value_at(spark, sf_dir, t):
    """Facts before the middle are gone but for each stream's last one."""
    with x.events_copy(spark, sf_dir) as db:
        asked = x.keys(db, FOREVER)
        db.retain(MID)
        return _shown(db.snapshot().value_at(asked, t))


def snapshot_isolation(spark, sf_dir):
    """A view taken before compaction and retention still has all facts."""
    with x.events_copy(spark, sf_dir) as db:
        view = db.snapshot()
        db.compact(0)
        db.retain(END)
        out = _totals(view.facts(tables={FOREVER}).where(F.col("table_id") == FOREVER)).withColumn("left", F.lit(len(db.state["units"])))
        out._view = view  # its files stay as long as the result
        return out


def export_sealed(spark, sf_dir):
    """The facts of a copied database."""
    target = folder(spark, "export")
    x.events_db(spark, sf_dir).export_sealed(target)
    with Db(spark, target, x.OPTIONS) as db:
        return _totals(db.snapshot().facts(tables={FOREVER}).where(F.col("table_id") == FOREVER))


# --- archive ---


def _archive(spark, options=None) -> ArchiveDb:
    return ArchiveDb(spark, folder(spark, "archive"), options)


def _all_records(db: ArchiveDb, after: ArchiveCursor, most: int):
    while not (chunk := db.export_durable(after, most)).is_empty:
        yield chunk
        after = chunk.end


def archive_feed(spark, sf_dir):
    """Every mutation comes out once, in order, in chunks of at most 500 bytes."""
    with _archive(spark) as db:
        start = db.archive_status().durable_end
        x.append_all(db, db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir), 4, db.sync)
        out = []
        for chunk in _all_records(db, start, 500):
            for r in ExportChunk.from_bytes(chunk.to_bytes()).records:
                op = json.loads(r)
                out.append((op["seq"], op["op"], op.get("ts"), sum(map(len, chunk.records)) <= 500))
        return spark.createDataFrame(out, "seq long, op string, ts long, within boolean")


def archive_release(spark, sf_dir):
    """The feed before and after what lies before its middle file's end is released; a pinned base holds it."""
    with _archive(spark) as db:
        rows, start = x.suppliers(spark, sf_dir), db.archive_status().durable_end
        x.append_all(db, db.create_table([(1, UINT)]), rows, 4, db.sync)
        before, middle = db.archive_status(), db._cursor(db._feed["files"][len(db._feed["files"]) // 2]["before"])
        db.release_archive(middle)
        after = db.archive_status()
        lost = x.rejected(lambda: db.export_durable(start, 1000))
        base = db.prepare_base(folder(spark, "base"))
        db.append(1, x.observation(rows[-1][0] + 1, 1, 1))
        end = ArchiveCursor.from_bytes(db.archive_status().durable_end.to_bytes())
        db.sync()
        held, pins = x.rejected(lambda: db.release_archive(db.archive_status().durable_end)), len(db.pending_bases())
        db.finish_base(base.base_id)
        db.release_archive(db.archive_status().durable_end)
        return spark.createDataFrame(
            [(before.earliest.seq, before.durable_end.seq, after.earliest.seq, after.bytes < before.bytes, after.healthy, lost, held, pins, len(db.pending_bases()), db.archive_status().bytes, db.archive_status().durable_end.covers(end))],
            "first long, last long, released long, smaller boolean, healthy boolean, lost boolean, held boolean, pins long, left long, bytes long, covers boolean",
        )


def chunk_suffixes(spark, sf_dir):
    """What is left of one chunk after each of its records."""
    with _archive(spark) as db:
        start = db.archive_status().durable_end
        x.append_all(db, db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir))
        db.sync()
        whole = ExportChunk.joined(_all_records(db, start, 4 << 20))
        out, at = [], start
        for _ in range(len(whole.records)):
            rest = whole.suffix_after(at)
            out.append((at.seq, len(rest.records), rest.end == whole.end))
            at = db.export_durable(at, 1).end
        return spark.createDataFrame(out, "seq long, records long, same_end boolean")


def _restored(spark, db: ArchiveDb, base, described, target: str):
    b = RestoreBuilder.install(spark, base, described, target)
    for chunk in _all_records(db, base.cursor, 4 << 20):
        b.apply_archive(chunk)
        b.apply_archive(chunk)  # the same again does nothing
        b = RestoreBuilder.open(spark, target)
    return b, b.applied_cursor() == db.archive_status().durable_end


def restore_after_bulk(spark, sf_dir):
    """A replica of bulk appends made after its base was frozen."""
    fields = [(i, UINT) for i in range(1, 6)]
    with _archive(spark, x.OPTIONS) as db:
        db.create_table(fields)
        base = db.prepare_base(folder(spark, "base"))
        described, facts = db.describe_base(base), event_facts(spark, sf_dir)
        db.append_frame(facts.where(F.col("ts") < MID))
        db.compact(0)
        db.append_frame(facts.where(F.col("ts") >= MID))
        b, applied = _restored(spark, db, base, described, folder(spark, "restore"))
        with Db(spark, b.finish().directory, x.OPTIONS) as copy:
            return copy.snapshot().facts().select("series_id", "field_id", "ts", F.col("u").cast("long").alias("u"), F.lit(applied).alias("applied"))


def restore_suppliers(spark, sf_dir):
    """Half of the suppliers come with the base, half with the feed; the result becomes a member of a namespace and goes on."""
    with _archive(spark) as db:
        t, rows = db.create_table([(1, UINT)]), x.suppliers(spark, sf_dir)
        half = (len(rows) + 1) // 2
        x.append_all(db, t, rows[:half])
        base = db.prepare_base(folder(spark, "base"))
        described = db.describe_base(base)
        x.append_all(db, t, rows[half:])
        db.sync()
        b, applied = _restored(spark, db, base, described, folder(spark, "restore"))
        done = b.finish()
    space, member = Namespace(spark, folder(spark, "space")), bytes(31) + b"\1"
    with space.install_restored_with_archive(member, done) as copy:
        copy.append(t, x.observation(rows[-1][0] + 1, 99, 7))
        feed = copy.archive_status().durable_end.seq
        return x.shown(copy.snapshot().facts()).withColumn("applied", F.lit(applied)).withColumn("base_files", F.lit(bool(described.files) and all(len(f.sha256) == 64 for f in described.files))).withColumn("feed", F.lit(feed).cast("long"))


def shared_log(spark, sf_dir):
    """Suppliers dealt to three databases with one log: each sync of all is one file; sealing the members frees it."""
    space, rows = Namespace(spark, folder(spark, "space")), x.suppliers(spark, sf_dir)
    ids = [bytes(31) + bytes([i]) for i in range(3)]
    dbs = [space.open_db(i) for i in ids]
    for db in dbs:
        db.create_table([(1, UINT)])
    for ts, series, u in rows:
        dbs[ts % 3].append(1, x.observation(ts, series, u))
    waiting = space.maintenance_status()
    space.sync()
    status, blockers, out = space.maintenance_status(), [], []
    for k, db in enumerate(dbs):
        blockers.append(len(space.maintenance_blockers()))
        db.seal()
    for k, db in enumerate(dbs):
        out.append((k, db.durable_seq, blockers[k], waiting.visible_lsn - waiting.durable_lsn, status.durable_lsn, status.write_calls, status.members, len(space.files.list("log")), space.collect_log()))
        db.close()
    space.discard_unpublished(ids[0])
    gone = x.rejected(lambda: space.open_db(ids[0]))
    return spark.createDataFrame([(*r, gone, space.maintenance_status().members) for r in out], "member long, durable long, blockers long, waiting long, lsn long, writes long, members long, files long, collected long, gone boolean, left long")


# --- command line, guards, errors ---


def cli_session(spark, sf_dir):
    """What the command line prints while regions are appended, looked up and maintained."""
    root, n, out = folder(spark, "cli"), 0, []
    regions = sorted(r["r_regionkey"] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect())

    def run(verb, *a):
        nonlocal n
        for line in cli.run(spark, [verb, root, *map(str, a)]) or [""]:
            out.append((n, verb, line))
            n += 1

    run("init")
    run("create-table", "1:uint", "--validity", "100")
    for k in regions:
        run("append", 1, 10 * (k + 1), f"7:1:u:{k * k}")
    run("sync")
    run("seal")
    run("scan", "1:7:1", 0, 1000)
    run("value-at", 25, "1:7:1", "1:8:1")
    run("latest", "1:7:1")
    run("aggregate", 0, 100, 50, "1:7:1")
    run("sample", 5, 30, 10, "1:7:1")
    run("maintain")
    run("compact", "l0")
    run("retain", 1000)
    return spark.createDataFrame(out, "n int, verb string, line string")


def guards(spark, sf_dir):
    """The kind of error that each bad request of a table meets, before any job starts."""
    db = x.events_db(spark, sf_dir)
    view, key = db.snapshot(), (FOREVER, 1, 1)
    with x.events_copy(spark, sf_dir) as old:
        old.retain(MID)
        late = old.snapshot()
        bad = {
            "inverted range": lambda: view.scan(key, END, START), "zero width": lambda: view.aggregate([key], START, END, 0), "zero step": lambda: view.sample([key], START, END, 0),
            "unknown table": lambda: view.latest([(99, 1, 1)]), "unknown field": lambda: view.value_at([(FOREVER, 1, 9)], START), "too many slots": lambda: view.sample([key], START, END, 1),
            "before the floor": lambda: late.value_at([key], START), "range before the floor": lambda: late.scan(key, START, END),
            "empty observation": lambda: old.append(FOREVER, Observation(END + DAY, ())), "wrong type": lambda: old.append(FOREVER, Observation(END + DAY, ((1, 1, Value.f32_bits(1)),))),
            "entries out of order": lambda: old.append(FOREVER, Observation(END + DAY, ((2, 1, Value.null()), (1, 1, Value.null())))), "level": lambda: old._compact([], 2),
            "options": lambda: OpenOptions(SyncPolicy(0)).validate(), "export into itself": lambda: old.export_sealed(f"{old.root}/x"), "cursor": lambda: ArchiveCursor.from_bytes(b"short"),
        }
        out = []
        for name, call in bad.items():
            try:
                call()
                out.append((name, "none"))
            except TidemarkError as e:
                out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "request string, error string")


# --- functions ---


def _sectioned(spark, sf_dir, kind=UINT):
    return codec.sections(event_facts(spark, sf_dir, kind), START, SECTION)


STREAM = ["series_id", "field_id", "section"]


def sections_round_trip(spark, sf_dir):
    """Facts packed into sections and unpacked."""
    packed = codec.pack_sections(_sectioned(spark, sf_dir), STREAM)
    return codec.unpack_sections(packed, STREAM).select("series_id", "field_id", "ts", F.col("value").cast("long").alias("u"))


def sections_packed(spark, sf_dir):
    """Which encoding each section's values and times take, and their bytes."""
    p = codec.pack_sections(_sectioned(spark, sf_dir), STREAM)
    return p.select(*STREAM, "rows", "encoding", F.length("data").cast("long").alias("data_bytes"), "time_encoding", F.length("times").cast("long").alias("time_bytes"))


def encoding_selector(spark, sf_dir):
    """The estimate of the same choice without packing anything."""
    c = codec.encoding_choice(_sectioned(spark, sf_dir).select(*STREAM, "ts", "u"), STREAM)
    return c.select(*STREAM, "rows", "fixed_bytes", "run_bytes", "encoding")


def workload_numbers(spark, sf_dir):
    """The generator's scrambled and interpolated numbers, for every event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return e.select("event_id", splitmix(F.col("event_id")).cast("string").alias("mixed"), lerp(F.lit(-1_000_000), F.lit(999_983), F.col("event_id"), F.lit(100_003)).alias("between"))


def sq1_decode(spark, sf_dir):
    return spark.range(256).select(F.col("id").cast("int").alias("code"), sq1_fp4(F.col("id")).cast("long").alias("fp4"))


def f32_order_key(spark, sf_dir):
    """The place of each float among its stream's by total order of patterns."""
    f = event_facts(spark, sf_dir, F32).where("kind = 3").withColumn("k", f32_order(F.col("f")))
    place = F.rank().over(W.partitionBy("series_id", "field_id").orderBy("k")).cast("long")
    return f.select(F.col("seq").alias("event_id"), place.alias("place"))


def delta2_zigzag(spark, sf_dir):
    f = _sectioned(spark, sf_dir).select(*STREAM, "ts", "u")
    return codec.delta2(f, STREAM).select("series_id", "field_id", "ts", F.col("code").cast("long").alias("code"))


def delta2_round_trip(spark, sf_dir):
    f = _sectioned(spark, sf_dir).select(*STREAM, "ts", "u")
    return codec.undelta2(codec.delta2(f, STREAM), STREAM).select("series_id", "field_id", "ts", F.col("decoded").cast("long").alias("u"))


def f32_xor_round_trip(spark, sf_dir):
    f = _sectioned(spark, sf_dir, F32).select(*STREAM, "ts", "f")
    return codec.unxor(codec.xor_previous(f, STREAM), STREAM).select("series_id", "field_id", "ts", f32_value(F.col("decoded")).cast("double").alias("value"))


def nvr_run_lengths(spark, sf_dir):
    f = _sectioned(spark, sf_dir).select(*STREAM, "ts", "u")
    t = codec.run_tokens(f.withColumnRenamed("u", "code"), STREAM)
    return t.select(*STREAM, "token", "first_ts", "length", F.col("size").cast("long").alias("size"))


def fixed_width_size(spark, sf_dir):
    f = _sectioned(spark, sf_dir).select(*STREAM, "ts", "u")
    return codec.encoding_choice(f, STREAM).select(*STREAM, "rows", "fixed_bytes")


def presence_size(spark, sf_dir):
    f = event_facts(spark, sf_dir).select("table_id", "series_id", "field_id", "ts")
    return codec.presence_size(f, ["series_id", "field_id"], ["table_id"])


def queries() -> dict:
    q = lambda f, *a, **k: lambda spark, sf_dir: f(spark, sf_dir, *a, **k)
    return {
        "agg_uint": q(_agg), "agg_sq1_fp4": q(_agg, SQ1), "agg_f32_minmax": q(_agg, F32), "agg_no_nulls": q(_agg, nulls=False),
        "agg_clipped_partial": q(_agg, end=END - DAY // 2, width=7 * DAY), "agg_multi_key": q(_agg, width=10 * DAY, repeat=2),
        "scan_range": q(_scan, START, END), "scan_empty_range": q(_scan, START, START), "cli_scan_rows": cli_scan_rows,
        "value_at_forever": q(_value_at), "value_at_validity": q(_value_at, SHORT), "value_at_multi_key_dups": q(_value_at, SHORT, repeat=3),
        "value_at_retired_series": q(_value_at, NO_SERIES, t=START + 13 * DAY), "value_at_retired_field": q(_value_at, NO_FIELD),
        "value_at_retired_both": q(_value_at, NEITHER), "value_at_versions": q(_value_at, TWO, t=MID + DAY // 12),
        "value_at_with_heads": q(_retain_then_value_at, MID + DAY // 24), "retain_then_value_at": q(_retain_then_value_at, AT), "latest_table_clock": latest_table_clock,
        "sample_carry": q(_sample), "sample_validity_gap": q(_sample, SHORT), "sample_versions": q(_sample, TWO),
        "table_last_ts": table_last_ts, "table_versions": table_versions, "retention_floor": retention_floor,
        "ingest_validate_schema": ingest_validate_schema, "stream_ingest": stream_ingest, "append_replay": append_replay, "append_rejections": append_rejections,
        "append_batches": append_batches, "sync_positions": sync_positions, "append_growth": append_growth, "create_and_drop_tables": create_and_drop_tables,
        "new_version": new_version, "retire_series_revived": q(_retired, False), "retire_field_kept": q(_retired, True), "seal_units": seal_units, "compact_reports": compact_reports,
        "deferred_gc": deferred_gc, "maintenance_status": maintenance_status, "takeover": takeover, "units_zone_map": units_zone_map, "unit_verify": unit_verify,
        "retain_heads": retain_heads, "compact_preserves_facts": compact_preserves_facts, "closed_window_selection": closed_window_selection,
        "snapshot_isolation": snapshot_isolation, "export_sealed": export_sealed, "archive_feed": archive_feed, "archive_release": archive_release, "chunk_suffixes": chunk_suffixes,
        "restore_after_bulk": restore_after_bulk, "restore_suppliers": restore_suppliers, "shared_log": shared_log, "cli_session": cli_session, "guards": guards,
        "sq1_decode": sq1_decode, "f32_order_key": f32_order_key, "delta2_zigzag": delta2_zigzag, "delta2_round_trip": delta2_round_trip,
        "f32_xor_round_trip": f32_xor_round_trip, "nvr_run_lengths": nvr_run_lengths, "fixed_width_size": fixed_width_size, "presence_size": presence_size,
        "sections_round_trip": sections_round_trip, "sections_packed": sections_packed, "encoding_selector": encoding_selector, "workload_numbers": workload_numbers,
    }


def oracle_sql() -> dict[str, str]:
    unit = f"(ts - {START}) // {UNIT}"
    zones = f"z AS (SELECT CAST({unit} AS BIGINT) AS unit_id, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS facts FROM f GROUP BY 1)"
    # a unit goes if it and all before it end before the cutoff
    expired = f"x AS (SELECT * FROM z a WHERE NOT EXISTS (SELECT 1 FROM z b WHERE b.min_ts <= a.min_ts AND b.max_ts >= {MID}))"
    floor = "(SELECT max(max_ts) + 1 FROM x)"
    varint = lambda v, bits: "(CASE " + " ".join(f"WHEN {v} < {2 ** (bits + 7 * n)} THEN {1 + n}" for n in range(9)) + " END)"
    section = f"(ts - {START}) // {SECTION}"
    within = f"PARTITION BY series_id, field_id, {section} ORDER BY ts"
    delta = f"""d AS (SELECT *, v - coalesce(lag(v) OVER ({within}), 0) AS s FROM f WHERE v IS NOT NULL),
      e AS (SELECT *, s - coalesce(lag(s) OVER ({within}), 0) AS c FROM d)"""
    zig = lambda c: f"CASE WHEN {c} >= 0 THEN 2 * {c} ELSE -2 * {c} - 1 END"
    run_size = lambda token, length, v: f"CASE {token} WHEN 'lit' THEN {varint(v, 6)} WHEN 'zero' THEN {varint(length, 5)} ELSE {varint(length, 4)} END"
    runs = lambda a: f"""(SELECT series_id, field_id, section, run, token, min(ts) AS first_ts, count(*) AS length, max(c) AS v FROM (
      SELECT *, sum(CAST(n AS INTEGER)) OVER (PARTITION BY series_id, field_id, section ORDER BY ts) AS run FROM (
        SELECT *, token = 'lit' OR coalesce(lag(token) OVER (PARTITION BY series_id, field_id, section ORDER BY ts) <> token, true) AS n FROM (
          SELECT *, CASE WHEN c IS NULL THEN 'null' WHEN c = 0 THEN 'zero' ELSE 'lit' END AS token FROM {a}))) GROUP BY ALL)"""  # noqa: E731
    values = f"a AS (SELECT f.series_id, f.field_id, (f.ts - {START}) // {SECTION} AS section, f.ts, {zig('e.c')} AS c FROM f LEFT JOIN e USING (event_id))"
    fixed = """CAST(1 + CASE WHEN coalesce(max(v), 0) < 256 THEN 1 WHEN max(v) < 65536 THEN 2 WHEN max(v) < 4294967296 THEN 4 ELSE 8 END * count(v)
            + CASE WHEN count(v) < count(*) THEN (count(*) + 7) // 8 ELSE 0 END AS BIGINT)"""
    sizes = f"""{delta}, {values}, r AS (SELECT series_id, field_id, section, CAST(sum({run_size('token', 'length', 'v')}) AS BIGINT) AS run_bytes FROM {runs('a')} GROUP BY ALL),
      z AS (SELECT series_id, field_id, {section} AS section, count(*) AS rows, {fixed} AS fixed_bytes FROM f GROUP BY ALL)"""
    unit_facts = len(x.TABLES)
    totals = "table_id, count(*) AS facts, CAST(sum(v) AS BIGINT) AS total, CAST(sum(ts % 1000003) AS BIGINT) AS clock, count(*) - count(v) AS nulls"
    revived = lambda back: f"""WITH {SUPPLIERS_SQL}, p AS (SELECT * FROM s WHERE n <= (c + 1) // 2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) = 1),
      k AS (SELECT DISTINCT series_id FROM s), r AS (SELECT k.series_id, p.ts, p.u, p.ts IS NOT NULL AND ({back.replace('series_id IN', 'k.series_id IN')}) AS live FROM k LEFT JOIN p USING (series_id))
      SELECT series_id, CASE WHEN NOT live THEN 'missing' WHEN u IS NULL THEN 'null' ELSE 'value' END AS state, CASE WHEN live THEN u END AS u, CASE WHEN live THEN ts END AS at_ts FROM r"""  # noqa: E731
    short = f"p.ts IS NOT NULL AND {floor} - p.ts < {8 * HOURS * MICRO}"
    return {
        "agg_uint": _agg_sql(), "agg_sq1_fp4": _agg_sql(SQ1), "agg_f32_minmax": _agg_sql(F32), "agg_no_nulls": _agg_sql(nulls=False),
        "agg_clipped_partial": _agg_sql(end=END - DAY // 2, width=7 * DAY), "agg_multi_key": _agg_sql(width=10 * DAY, repeat=2),
        "scan_range": _scan_sql(START, END), "scan_empty_range": _scan_sql(START, START),
        "cli_scan_rows": f"WITH {_facts_sql()} SELECT concat(ts, chr(9), CASE WHEN kind = 0 THEN 'null' ELSE concat('u:', v) END) AS line FROM f",
        "value_at_forever": _value_at_sql(), "value_at_validity": _value_at_sql(HOURLY), "value_at_multi_key_dups": _value_at_sql(HOURLY, repeat=3),
        "value_at_retired_series": _value_at_sql(series=True, t=START + 13 * DAY), "value_at_retired_field": _value_at_sql(fields=True),
        "value_at_retired_both": _value_at_sql(series=True, fields=True), "value_at_versions": _value_at_sql(CHANGED, t=MID + DAY // 12),
        "value_at_with_heads": _value_at_sql(t=MID + DAY // 24), "retain_then_value_at": _value_at_sql(),
        "latest_table_clock": _value_at_sql([(ALWAYS, None, 40 * HOURS)], t="(SELECT max(ts) FROM f)"),
        "sample_carry": _sample_sql(), "sample_validity_gap": _sample_sql(HOURLY), "sample_versions": _sample_sql(CHANGED),
        "table_last_ts": f"WITH {_facts_sql()} SELECT table_id, max(ts) AS last_ts FROM f GROUP BY 1",
        "retention_floor": f"WITH {_facts_sql()}, {zones}, {expired} SELECT max(max_ts) + 1 AS floor, count(*) AS removed_units FROM x",
        "ingest_validate_schema": f"""WITH {_facts_sql()} SELECT CAST(field_id AS INTEGER) AS field_id, CASE WHEN field_id = 5 THEN 'unknown field' ELSE 'type mismatch' END AS reason, count(*) AS rows
          FROM f WHERE field_id = 5 OR (field_id = 4 AND kind <> 0) GROUP BY 1, 2""",
        "retain_heads": f"""WITH {_facts_sql()}, {zones}, {expired},
          p AS (SELECT * FROM f WHERE {unit} IN (SELECT unit_id FROM x) QUALIFY row_number() OVER (PARTITION BY series_id, field_id ORDER BY ts DESC) = 1)
          SELECT series_id, CAST(field_id AS INTEGER) AS field_id, ts, CAST(kind AS INTEGER) AS kind, v AS u FROM p WHERE {short}""",
        "sq1_decode": """SELECT CAST(i AS INTEGER) AS code, CAST(CASE WHEN i <= 50 THEN i * 1000 WHEN i <= 78 THEN 50000 + (i - 50) * 2500 WHEN i <= 254 THEN 120000 + (i - 78) * 5000 END AS BIGINT) AS fp4 FROM range(256) AS t(i)""",
        "delta2_zigzag": f"""WITH {_facts_sql()}, {delta} SELECT f.series_id, CAST(f.field_id AS INTEGER) AS field_id, f.ts, CAST(CASE WHEN c >= 0 THEN 2 * c ELSE -2 * c - 1 END AS BIGINT) AS code
          FROM f LEFT JOIN e USING (event_id)""",
        "delta2_round_trip": f"WITH {_facts_sql()} SELECT series_id, CAST(field_id AS INTEGER) AS field_id, ts, v AS u FROM f",
        "f32_xor_round_trip": f"WITH {_facts_sql(F32)} SELECT series_id, CAST(field_id AS INTEGER) AS field_id, ts, CAST(v AS DOUBLE) AS value FROM f",
        "presence_size": f"""WITH {_facts_sql()}, r AS (SELECT count(DISTINCT ts) AS rows FROM f)
          SELECT table_id, series_id, CAST(field_id AS INTEGER) AS field_id, count(*) AS facts, any_value(rows) AS rows, CASE WHEN count(*) = any_value(rows) THEN 0 ELSE (any_value(rows) + 7) // 8 END AS presence_bytes
          FROM f, r GROUP BY 1, 2, 3""",
        "f32_order_key": f"WITH {_facts_sql(F32)} SELECT event_id, rank() OVER (PARTITION BY series_id, field_id ORDER BY v) AS place FROM f WHERE v IS NOT NULL",
        "fixed_width_size": f"""WITH {_facts_sql()} SELECT series_id, CAST(field_id AS INTEGER) AS field_id, {section} AS section, count(*) AS rows, {fixed} AS fixed_bytes FROM f GROUP BY 1, 2, 3""",
        "nvr_run_lengths": f"""WITH {_facts_sql()}, a AS (SELECT *, {section} AS section, v AS c FROM f)
          SELECT series_id, CAST(field_id AS INTEGER) AS field_id, section, token, first_ts, length, CAST({run_size('token', 'length', 'v')} AS BIGINT) AS size FROM {runs('a')}""",
        "encoding_selector": f"""WITH {_facts_sql()}, {sizes} SELECT series_id, CAST(field_id AS INTEGER) AS field_id, section, rows, fixed_bytes, run_bytes, CASE WHEN run_bytes < fixed_bytes THEN 'runs' ELSE 'fixed' END AS encoding
          FROM z JOIN r USING (series_id, field_id, section)""",
        "sections_packed": f"""WITH {_facts_sql()}, {sizes}, td AS (SELECT *, ts - coalesce(lag(ts) OVER ({within}), 0) AS s FROM f), te AS (SELECT *, s - coalesce(lag(s) OVER ({within}), 0) AS c FROM td),
          ta AS (SELECT series_id, field_id, {section} AS section, ts, {zig('c')} AS c FROM te),
          tr AS (SELECT series_id, field_id, section, CAST(sum({run_size('token', 'length', 'v')}) AS BIGINT) AS b FROM {runs('ta')} GROUP BY ALL)
          SELECT series_id, CAST(field_id AS INTEGER) AS field_id, section, rows, CASE WHEN run_bytes < fixed_bytes THEN 'runs' ELSE 'fixed' END AS encoding, least(run_bytes, fixed_bytes) AS data_bytes,
            CASE WHEN b < 8 * rows THEN 'runs' ELSE 'fixed' END AS time_encoding, least(b, 8 * rows) AS time_bytes FROM z JOIN r USING (series_id, field_id, section) JOIN tr USING (series_id, field_id, section)""",
        "sections_round_trip": f"WITH {_facts_sql()} SELECT series_id, CAST(field_id AS INTEGER) AS field_id, ts, v AS u FROM f",
        "workload_numbers": """WITH RECURSIVE a AS (SELECT event_id, (event_id::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM events),
          b AS (SELECT event_id, (xor(v::UBIGINT, v::UBIGINT >> 30)::UHUGEINT) AS v FROM a), c AS (SELECT event_id, ((v % 4294967296::UHUGEINT) * 13787848793156543929::UHUGEINT + (((v // 4294967296::UHUGEINT) * 13787848793156543929::UHUGEINT) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM b),
          d AS (SELECT event_id, (xor(v::UBIGINT, v::UBIGINT >> 27)::UHUGEINT) AS v FROM c), e AS (SELECT event_id, ((v % 4294967296::UHUGEINT) * 10723151780598845931::UHUGEINT + (((v // 4294967296::UHUGEINT) * 10723151780598845931::UHUGEINT) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM d)
          SELECT event_id, CAST(xor(v::UBIGINT, v::UBIGINT >> 31) AS VARCHAR) AS mixed, -1000000 + CAST((1999983::HUGEINT * event_id) // 100003 AS BIGINT) AS between FROM e""",
        "table_versions": f"""WITH {_facts_sql()} SELECT CAST(CASE WHEN ts < {MID} THEN 1 ELSE 2 END AS INTEGER) AS version_no, min(ts) AS effective_from,
          CAST(CASE WHEN ts < {MID} THEN {HOURS} ELSE {8 * HOURS} END AS BIGINT) AS validity_s, CAST(5 AS INTEGER) AS fields FROM f GROUP BY 1, 3""",
        "stream_ingest": f"WITH {_facts_sql()} SELECT {totals} FROM f GROUP BY 1", "export_sealed": f"WITH {_facts_sql()} SELECT {totals} FROM f GROUP BY 1",
        "compact_preserves_facts": f"WITH {_facts_sql()} SELECT {totals}, CAST(1 AS INTEGER) AS units FROM f GROUP BY 1",
        "snapshot_isolation": f"WITH {_facts_sql()} SELECT {totals}, CAST(CASE WHEN max(ts) < {END} THEN 0 ELSE 1 END AS INTEGER) AS left FROM f GROUP BY 1",
        "units_zone_map": f"WITH {_facts_sql()}, {zones} SELECT unit_id + 1 AS unit_id, min_ts, max_ts, facts * {unit_facts} AS facts FROM z",
        "unit_verify": f"WITH {_facts_sql()}, {zones} SELECT unit_id + 1 AS unit_id, CAST(t AS BIGINT) AS table_id, min_ts, max_ts, facts, (SELECT count(*) FROM z) AS checked FROM z, range(1, {unit_facts + 1}) AS r(t)",
        "closed_window_selection": f"""WITH {_facts_sql()}, {zones}, w AS (SELECT *, min_ts // {WINDOW} AS a, max_ts // {WINDOW} AS b, (SELECT max(max_ts) FROM z) >= (min_ts // {WINDOW} + 1) * {WINDOW} AS closed FROM z)
          SELECT CAST(1 AS INTEGER) AS level, min(min_ts) AS min_ts, max(max_ts) AS max_ts, CAST(sum(facts) * {unit_facts} AS BIGINT) AS facts FROM w WHERE a = b AND closed GROUP BY a
          UNION ALL SELECT 0, min_ts, max_ts, facts * {unit_facts} FROM w WHERE NOT (a = b AND closed)""",
        "restore_after_bulk": f"WITH {_facts_sql()} SELECT series_id, CAST(field_id AS INTEGER) AS field_id, ts, v AS u, true AS applied FROM f",
        "append_replay": f"WITH {SUPPLIERS_SQL} SELECT series_id, ts, u, c + 1 AS replayed, 0::BIGINT AS repairs FROM s",
        "append_rejections": f"""WITH {SUPPLIERS_SQL}, m AS (SELECT ts AS supplier, coalesce(ts * 7 % 101 <= max(ts * 7 % 101) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS rejected FROM s)
          SELECT supplier, rejected, CASE WHEN rejected THEN 0 ELSE 1 END::BIGINT AS taken FROM m""",
        "append_batches": f"WITH {SUPPLIERS_SQL} SELECT series_id, ts, u FROM (SELECT *, (n - 1) // 5 AS b, count(*) OVER (PARTITION BY (n - 1) // 5) AS size FROM s) WHERE b % 3 <> 2 OR size = 1",
        "sync_positions": f"WITH {SUPPLIERS_SQL} SELECT n + 1 AS visible, n + 1 AS durable, 0::BIGINT AS unsynced FROM s WHERE n % 4 = 0 OR n = c",
        "append_growth": "SELECT CAST(count(*) * 40 AS BIGINT) AS told, CAST(count(*) * 40 AS BIGINT) AS tail_bytes, count(*) * 40 <= 67108864 AS fits FROM supplier",
        "create_and_drop_tables": f"""WITH {SUPPLIERS_SQL}, t AS (SELECT series_id, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY series_id) AS table_id FROM s GROUP BY 1)
          SELECT table_id, series_id, n, CASE WHEN table_id % 2 = 1 THEN n END AS now, (SELECT count(*) + 1 FROM t) AS fresh FROM t""",
        "new_version": f"""WITH {SUPPLIERS_SQL} SELECT CAST(v AS INTEGER) AS version_no, min(ts) AS effective_from, CAST(4 * v + 1 AS BIGINT) AS validity_s, CAST(v AS INTEGER) AS fields, true AS refused
          FROM (SELECT *, CASE WHEN n <= (c + 1) // 2 THEN 1 ELSE 2 END AS v FROM s) GROUP BY v""",
        "retire_series_revived": revived("series_id IN (SELECT series_id FROM s WHERE n > (c + 1) // 2)"), "retire_field_kept": revived("false"),
        "seal_units": f"WITH {SUPPLIERS_SQL} SELECT (n - 1) // 4 + 1 AS unit_id, CAST(0 AS INTEGER) AS level, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS facts FROM s GROUP BY 1",
        "compact_reports": f"WITH {SUPPLIERS_SQL} SELECT CAST(1 AS INTEGER) AS level, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS facts, CAST((count(*) + 3) // 4 AS INTEGER) AS inputs, CAST(0 AS INTEGER) AS more FROM s",
        "deferred_gc": "SELECT (count(*) + 3) // 4 AS before, (count(*) + 3) // 4 + 1 AS held, count(*) AS facts, 1::BIGINT AS after FROM supplier",
        "maintenance_status": """SELECT count(*) - 4 AS pending, count(*) - 4 AS unsynced, count(*) + 1 AS visible, 5::BIGINT AS durable, 1::BIGINT AS level0, false AS sync_due, false AS seal_due,
          0::BIGINT AS wal_bytes, CAST(NULL AS BIGINT) AS floor FROM supplier""",
        "takeover": "SELECT s_suppkey AS ts, true AS refused, true AS stopped, 2::BIGINT AS epoch FROM supplier",
        "archive_feed": f"WITH {SUPPLIERS_SQL} SELECT 1::BIGINT AS seq, 'create_table' AS op, CAST(NULL AS BIGINT) AS ts, true AS within UNION ALL SELECT n + 1, 'observation', ts, true FROM s",
        "archive_release": """WITH c AS (SELECT count(*) AS n, (count(*) + 3) // 4 AS files FROM supplier) SELECT 0::BIGINT AS first, n + 1 AS last, CASE WHEN files < 2 THEN 0 ELSE 1 + files // 2 * 4 END::BIGINT AS released,
          true AS smaller, true AS healthy, true AS lost, true AS held, 1::BIGINT AS pins, 0::BIGINT AS left, 0::BIGINT AS bytes, true AS covers FROM c""",
        "chunk_suffixes": f"WITH {SUPPLIERS_SQL} SELECT n AS seq, c + 1 - n AS records, true AS same_end FROM s UNION ALL SELECT 0, c + 1, true FROM s WHERE n = 1",
        "restore_suppliers": f"WITH {SUPPLIERS_SQL} SELECT series_id, ts, u, true AS applied, true AS base_files, c + 1 AS feed FROM s UNION ALL SELECT 99, ts + 1, 7, true, true, c + 1 FROM s WHERE n = c",
        "shared_log": f"""WITH {SUPPLIERS_SQL} SELECT CAST(m AS BIGINT) AS member, (SELECT count(*) FROM s WHERE ts % 3 = m) + 1 AS durable, CAST(3 - m AS BIGINT) AS blockers, (SELECT count(*) + 3 FROM s) AS waiting, (SELECT count(*) + 3 FROM s) AS lsn,
          1::BIGINT AS writes, 3::BIGINT AS members, 0::BIGINT AS files, 0::BIGINT AS collected, true AS gone, 2::BIGINT AS left FROM range(3) AS r(m)""",
        "cli_session": """WITH k AS (SELECT r_regionkey AS k, 10 * (r_regionkey + 1) AS ts, r_regionkey * r_regionkey AS u, count(*) OVER () AS c FROM region),
          l AS (SELECT 0 AS a, 0 AS b, 'init' AS verb, 'ok' AS line UNION ALL SELECT 1, 0, 'create-table', '1' UNION ALL SELECT 2, k, 'append', CAST(k + 2 AS VARCHAR) FROM k
            UNION ALL SELECT 3, 0, 'sync', CAST(count(*) + 1 AS VARCHAR) FROM k UNION ALL SELECT 4, 0, 'seal', concat('1', chr(9), count(*) + 1) FROM k
            UNION ALL SELECT 5, k, 'scan', concat(ts, chr(9), 'u:', u) FROM k UNION ALL SELECT 6, 0, 'value-at', concat('value', chr(9), ts, chr(9), 'u:', u) FROM k WHERE ts = 20 UNION ALL SELECT 6, 1, 'value-at', 'missing'
            UNION ALL SELECT 7, 0, 'latest', concat('value', chr(9), ts, chr(9), 'u:', u) FROM k WHERE k + 1 = c
            UNION ALL SELECT 8, ts // 50, 'aggregate', concat_ws(chr(9), ts // 50 * 50, ts // 50 * 50 + 50, count(*), 0, concat('u:', min(u)), concat('u:', max(u)), concat('u:', sum(u)), CASE WHEN any_value(c) * 10 < ts // 50 * 50 + 50 THEN 'partial' ELSE 'complete' END) FROM k WHERE ts < 100 GROUP BY ts // 50
            UNION ALL SELECT 9, 0, 'sample', concat('5', chr(9), 'gap') UNION ALL SELECT 9, k + 1, 'sample', concat_ws(chr(9), ts + 5, 'value', ts, concat('u:', u), 'carried') FROM k WHERE ts + 5 < 30
            UNION ALL SELECT 10, 0, 'maintain', concat_ws(chr(9), 'false', 'false', 'false', 'false', 'false') UNION ALL SELECT 11, 0, 'compact', concat('0', chr(9), '-') UNION ALL SELECT 12, 0, 'retain', concat('1', chr(9), max(ts) + 1) FROM k)
          SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS n, verb, line FROM l""",
        "guards": """SELECT * FROM (VALUES ('inverted range', 'InvalidArgument'), ('zero width', 'InvalidArgument'), ('zero step', 'InvalidArgument'), ('unknown table', 'InvalidArgument'), ('unknown field', 'InvalidArgument'),
          ('too many slots', 'ResourceExhausted'), ('before the floor', 'InvalidArgument'), ('range before the floor', 'InvalidArgument'), ('empty observation', 'InvalidArgument'), ('wrong type', 'InvalidArgument'),
          ('entries out of order', 'InvalidArgument'), ('level', 'InvalidArgument'), ('options', 'InvalidArgument'), ('export into itself', 'InvalidArgument'), ('cursor', 'Corruption')) AS t(request, error)""",
    }
