from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.db import Db
from tidemark.errors import Corruption, InvalidArgument, ResourceExhausted
from tidemark.model import CompactionPolicy, Observation, OpenOptions, SealPolicy, SyncPolicy, Value

U, NULL = Value.uint, Value.null()


def put(db, table, ts, *entries):
    return db.append(table, Observation(ts, tuple(entries)))


def looked(df):
    return [(r["state"], r["at_ts"], None if r["u"] is None else int(r["u"])) for r in df.collect()]


def slots(df):
    return [(r["slot_ts"], r["state"], None if r["u"] is None else int(r["u"]), r["carried"]) for r in df.collect()]


def buckets(df):
    return [(r["start_ts"], r["end_ts"], r["sample_count"], r["null_count"], None if r["sum"] is None else int(r["sum"]), r["is_partial"]) for r in df.collect()]


def test_lookup_and_sample_vectors(spark, tmp_path):
    with Db(spark, f"file://{tmp_path}/db") as db:
        t = db.create_table([(1, 1), (2, 1)], 5)
        for ts, f, v in [(10, 1, U(10)), (12, 2, U(12)), (14, 1, NULL), (20, 1, U(20))]:
            put(db, t, ts, (7, f, v))
        s, one = db.snapshot(), (t, 7, 1)
        assert looked(s.value_at([one], 13)) == [("value", 10, 10)]
        assert looked(s.value_at([one, one], 14)) == [("null", 14, None)] * 2
        assert looked(s.value_at([one], 19)) == [("missing", None, None)]
        assert looked(s.latest([one, (t, 7, 2)])) == [("value", 20, 20), ("missing", None, None)]
        assert slots(s.sample([one], 9, 22, 2)) == [
            (9, "gap", None, None), (11, "value", 10, True), (13, "value", 10, True), (15, "null", None, True), (17, "null", None, True), (19, "gap", None, None), (21, "value", 20, True),
        ]
        for bad in (lambda: s.value_at([(t, 7, 9)], 1), lambda: s.sample([one], 0, 9, 0), lambda: s.scan(one, 5, 4)):
            with pytest.raises(InvalidArgument):
                bad()
        with pytest.raises(ResourceExhausted):
            s.sample([one], 0, 1_048_577, 1)
        db.retire_series(t, 7, 20)
        assert looked(db.snapshot().value_at([one], 21)) == [("missing", None, None)]
        put(db, t, 22, (7, 1, U(22)))
        assert looked(db.snapshot().latest([one])) == [("value", 22, 22)]


def test_aggregate_vectors(spark, tmp_path):
    with Db(spark, f"file://{tmp_path}/db") as db:
        t = db.create_table([(1, 1), (2, 2), (3, 3), (4, 1)])
        f = Value.f32_bits
        put(db, t, 0, (7, 1, U(5)), (7, 2, Value.sq1(50)), (7, 3, f(0x80000000)), (7, 4, NULL))
        put(db, t, 5, (7, 1, NULL), (7, 2, NULL), (7, 3, NULL), (7, 4, NULL))
        put(db, t, 10, (7, 1, U(7)), (7, 2, Value.sq1(78)), (7, 3, f(0)))
        put(db, t, 15, (7, 3, f(0x7FC01234)))
        s = db.snapshot()
        key = lambda i: (t, 7, i)
        assert buckets(s.aggregate([key(1)], 0, 20, 10)) == [(0, 10, 2, 1, 5, False), (10, 20, 1, 0, 7, True)]
        assert [b[4] for b in buckets(s.aggregate([key(2)], 0, 20, 10))] == [50_000, 120_000]
        rows = s.aggregate([key(3)], 0, 20, 10).collect()
        assert [(r["sum"], r["min_f"]) for r in rows] == [(None, 0x80000000), (None, 0)] and rows[1]["max_f"] == 0x7FC01234
        assert buckets(s.aggregate([key(4)], 0, 20, 10)) == [(0, 10, 2, 2, 0, False)]
        assert buckets(s.aggregate([key(1)], 0, 12, 10))[1] == (10, 12, 1, 0, 7, True)
        with pytest.raises(InvalidArgument):
            s.aggregate([key(1)], 0, 20, 0)


def test_lifecycle_keeps_answers(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    with Db(spark, root) as db:
        t = db.create_table([(1, 1)])
        key = (t, 1, 1)
        put(db, t, 10, (1, 1, U(10)))
        put(db, t, 20, (1, 1, NULL))
        assert db.seal().unit_id == 1
        put(db, t, 30, (1, 1, U(30)))
        put(db, t, 40, (1, 1, U(40)))
        db.seal()
        before = db.snapshot()
        report = db.compact(0)
        assert (report.input_units, report.output_unit) == (2, 3)
        assert [r["ts"] for r in db.snapshot().scan(key, 0, 50).collect()] == [10, 20, 30, 40]
        report = db.retain(41)
        assert (report.removed_units, report.floor) == (1, 41)
        now = db.snapshot()
        assert looked(now.value_at([key], 41)) == [("value", 40, 40)]
        assert slots(now.sample([key], 41, 43, 1)) == [(41, "value", 40, True), (42, "value", 40, True)]
        with pytest.raises(InvalidArgument):
            now.scan(key, 40, 42)
        assert [r["ts"] for r in before.scan(key, 0, 50).collect()] == [10, 20, 30, 40]
    with Db(spark, root) as db:
        assert looked(db.snapshot().value_at([key], 41)) == [("value", 40, 40)] and db.snapshot().retention_floor() == 41
        assert db.snapshot().table_last_timestamp(t) == 40


def test_reopen_replays_and_clock(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    with Db(spark, root) as db:
        t = db.create_table([(1, 1)], 5)
        put(db, t, -10, (1, 1, U(1)))
        for ts in (-10, -11):
            with pytest.raises(InvalidArgument):
                put(db, t, ts, (1, 1, U(1)))
        seq = db.visible_seq
        assert put(db, t, 20, (1, 1, U(2**64 - 1))) == seq + 1
        db.seal()
        assert db.new_table_version(t, [(1, 1), (2, 3)]) == 2
        with pytest.raises(InvalidArgument):
            db.new_table_version(t, [(1, 1), (2, 3), (3, 1)])
        put(db, t, 30, (2**63, 2, Value.f32_bits(0xFFFFFFFF)))
        assert db.try_append_batch(t, [Observation(31, ((1, 1, U(3)),)), Observation(32, ((1, 1, NULL),))]) is not None
        with pytest.raises(InvalidArgument):
            db.try_append_batch(t, [Observation(33, ((1, 1, U(3)),)), Observation(33, ((1, 1, NULL),))])
        db.compact(0)
    with Db(spark, root) as db:
        assert db.report.replayed_records == 4
        s = db.snapshot()
        assert [v.effective_from for v in s.table_versions(t)] == [-10, 30] and s.table_last_timestamp(t) == 32
        assert looked(s.value_at([(t, 1, 1)], 20)) == [("value", 20, 2**64 - 1)]
        assert s.value_at([(t, 2**63, 2)], 99).collect()[0]["f"] == 0xFFFFFFFF
        with pytest.raises(InvalidArgument):
            Db(spark, root)
        db.drop_table(t)
        with pytest.raises(InvalidArgument):
            db.snapshot().table_last_timestamp(t)
        assert s.table_last_timestamp(t) == 32
        assert db.create_table([]) == t + 1


def test_maintain_levels(spark, tmp_path):
    options = OpenOptions(SyncPolicy(1e-9), SealPolicy(1, 1e-9), CompactionPolicy(100, 200))
    with Db(spark, f"file://{tmp_path}/db", options) as db:
        t = db.create_table([(1, 1)])
        for ts in (10, 20, 110, 120, 210):
            put(db, t, ts, (1, 1, U(ts)))
            db.seal()
        assert db.maintain().more_due
        assert db.maintenance_status().level_units == [3, 0, 1]
        assert not db.maintain().more_due
        assert db.maintenance_status().level_units == [1, 0, 2]
        assert [r["ts"] for r in db.snapshot().scan((t, 1, 1), 0, 999).collect()] == [10, 20, 110, 120, 210]


def test_bulk_frame(spark, tmp_path):
    with Db(spark, f"file://{tmp_path}/db") as db:
        t = db.create_table([(1, 1), (2, 1)])
        rows = spark.range(1000).selectExpr(f"cast({t} as long) table_id", "id % 10 series_id", "1 field_id", "id ts", "cast(1 as tinyint) kind", "cast(id as decimal(20,0)) u", "cast(null as smallint) q", "cast(null as long) f")
        db.append_frame(rows)
        assert db.verify() == 1
        assert db.snapshot().facts().count() == 1000 and db.snapshot().table_last_timestamp(t) == 999
        with pytest.raises(InvalidArgument):
            db.append_frame(rows)
        with pytest.raises(InvalidArgument):
            db.append_frame(rows.withColumn("ts", rows.ts + 1000).withColumn("field_id", rows.field_id + 5))


FRAME = "cast(1 as long) table_id", "id % {n} series_id", "1 field_id", "id ts", "cast(1 as tinyint) kind", "cast(id as decimal(20,0)) u", "cast(null as smallint) q", "cast(null as long) f"


def frame(spark, low, high, n=10):
    return spark.range(low, high).selectExpr(*[x.format(n=n) for x in FRAME])


def test_verify_finds_one_changed_value(spark, tmp_path):
    with Db(spark, f"file://{tmp_path}/db") as db:
        db.create_table([(1, 1)])
        db.append_frame(frame(spark, 0, 200))
        for name in ("facts", "last"):
            path = f"file://{tmp_path}/db/{db.state['units'][0]['path']}/{name}"
            good, schema = spark.read.parquet(path).collect(), spark.read.parquet(path).schema
            at = good[0]["ts"]
            for change in ({"val": 7_000}, {"series_id": 33}, {"kind": 3}, {"val": None, "big": Decimal(50)}):
                bad = [r.asDict() | change if r["ts"] == at else r.asDict() for r in good]
                spark.createDataFrame(bad, schema).write.mode("overwrite").parquet(path)
                for use in (db.verify, lambda: db._compact(db.state["units"], 0), lambda: db.retain(1000)):
                    with pytest.raises(Corruption):
                        use()
            spark.createDataFrame(good, schema).write.mode("overwrite").parquet(path)
        assert db.verify() == 1 and db._compact(db.state["units"], 0).input_units == 1 and db.verify() == 1


def test_integers_beyond_a_long_and_all_kinds_survive(spark, tmp_path):
    with Db(spark, f"file://{tmp_path}/db") as db:
        t = db.create_table([(1, 1), (2, 2), (3, 3)])
        for ts, u in enumerate((0, 2**63 - 1, 2**63, 2**64 - 1)):
            put(db, t, ts, (2**64 - 1, 1, U(u)), (2**64 - 1, 2, Value.sq1(254)), (2**64 - 1, 3, Value.f32_bits(0xFFFFFFFF)))
        put(db, t, 9, (2**64 - 1, 1, NULL), (2**64 - 1, 2, NULL), (2**64 - 1, 3, NULL))
        before = sorted(map(tuple, db.snapshot().facts().collect()))
        db.seal()
        assert sorted(map(tuple, db.snapshot().facts().collect())) == before and len(before) == 15


def test_lookups_read_last_facts_of_ended_units(spark, tmp_path):
    with Db(spark, f"file://{tmp_path}/db") as db:
        db.create_table([(1, 1)])
        db.create_table([(1, 1)])
        for low in (0, 100, 200):
            db.append_frame(frame(spark, low, low + 100))
        s, keys = db.snapshot(), [(1, i, 1) for i in range(12)]
        used = lambda df: sorted({"/".join(f.split("/")[-3:-1]) for f in df.inputFiles()})
        name = lambda k, part: f"{db.state['units'][k]['path'].split('/')[1]}/{part}"
        assert used(s.facts_upto(250, None, {1})) == [name(0, "last"), name(1, "last"), name(2, "facts")]
        assert used(s.facts_upto(None, None, {1})) == [name(k, "last") for k in range(3)] and used(s.facts(None, None, {2})) == []
        want = [("value", 240 + i, 240 + i) if i <= 9 else ("missing", None, None) for i in range(12)]
        assert looked(s.value_at(keys, 249)) == want
        assert looked(s.latest(keys))[:10] == [("value", 290 + i, 290 + i) for i in range(10)]
        assert slots(s.sample([(1, 3, 1)], 95, 130, 10)) == [(95, "value", 93, True), (105, "value", 103, True), (115, "value", 113, True), (125, "value", 123, True)]


def test_broken_order_and_versions_are_corruption(spark, tmp_path):
    with Db(spark, f"file://{tmp_path}/db") as db:
        t = db.create_table([(1, 1)], 5)
        db.append_frame(frame(spark, 0, 10))
        put(db, t, 10, (1, 1, U(1)))
        state = db.state["units"][0]["tables"]["1"]
        state[1], db._cached = 10, None
        with pytest.raises(Corruption):
            db.snapshot()
        state[1], db._cached = 9, None
        db.state["tables"]["1"]["versions"][0]["effective_from"] = 5
        with pytest.raises(Exception, match="no version is active"):
            db.snapshot().value_at([(1, 4, 1)], 4).collect()


def test_limits_and_options(spark, tmp_path, monkeypatch):
    bad = [OpenOptions(SyncPolicy(0)), OpenOptions(SyncPolicy(1, 0)), OpenOptions(seal=SealPolicy(0)), OpenOptions(seal=SealPolicy(1, 1, 1 << 40)), OpenOptions(compaction=CompactionPolicy(0, 5)), OpenOptions(compaction=CompactionPolicy(9, 5)), OpenOptions(compaction=CompactionPolicy(1.5, 5)), OpenOptions(ticks_per_second=0)]
    for o in bad:
        with pytest.raises(InvalidArgument):
            o.validate()
    with pytest.raises(ResourceExhausted):
        OpenOptions(directory_cache_bytes=1 << 30).validate()
    OpenOptions(SyncPolicy(0, 0, True)).validate()
    monkeypatch.setattr("tidemark.db.TAIL_LIMIT", 160)
    with Db(spark, f"file://{tmp_path}/db", OpenOptions(seal=SealPolicy(10))) as db:
        t = db.create_table([(1, 1)])
        assert db.tail_limit_bytes() == 160 and db.estimated_append_growth(Observation(1, ((1, 1, U(1)),))) == 40
        for ts in range(4):
            put(db, t, ts, (1, 1, U(1)))
        seq = db.visible_seq
        for use in (lambda: put(db, t, 4, (1, 1, U(1))), lambda: db.try_append_batch(t, [Observation(5, ((1, 1, U(1)),))])):
            with pytest.raises(ResourceExhausted):
                use()
        assert db.visible_seq == seq
        db.seal()
        put(db, t, 4, (1, 1, U(1)))
        status = db.maintenance_status()
        assert status.wal_bytes == 0 and status.unsynced_bytes > 0 and status.tail_bytes == 40 and status.seal_due
        db.sync()
        assert db.maintenance_status().wal_bytes > 0 and db.metrics["append"][0] == 6 and db.metrics["seal"][0] == 1


def test_one_of_two_writers_publishes(spark, tmp_path):
    from tidemark.sources import manifest

    with Db(spark, f"file://{tmp_path}/db") as db:
        db.create_table([(1, 1)])
        other = Db(spark, f"file://{tmp_path}/db", OpenOptions(takeover=True))
        assert other.state["writer_epoch"] == db.state["writer_epoch"] + 1
        other.create_table([(1, 1)])
        other.seal()
        with pytest.raises(InvalidArgument):
            db.seal()
        with pytest.raises(Exception, match="open the database again"):
            db.seal()
        db._poisoned, db._unsynced = False, []
        db.files.create(manifest.claim(other.state["generation"] + 1), b"dead")
        other.close()
        with Db(spark, f"file://{tmp_path}/db", OpenOptions(takeover=True)) as again:
            again.create_table([(1, 1)])
            assert again.seal().checkpointed_records == 1


def test_published_files_are_never_missing(spark, tmp_path, monkeypatch):
    from tidemark.sources.fs import Files

    f = Files(spark, f"file://{tmp_path}/x")
    f.mkdirs()
    f.publish("a", b"old")
    monkeypatch.setattr(Files, "rename", lambda *a, **k: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        f.publish("a", b"new")
    assert f.read("a") == b"old"
    monkeypatch.undo()
    f.publish("a", b"new")
    assert f.read("a") == b"new"


def test_stream_takes_each_batch_once(spark, tmp_path):
    import os

    from tidemark.streaming.ingest import stream_into

    frame(spark, 0, 100, 3).coalesce(1).write.parquet(f"{tmp_path}/in")
    start = lambda db, **k: stream_into(spark.readStream.schema(frame(spark, 0, 1).schema).parquet(f"{tmp_path}/in"), db, f"{tmp_path}/cp", **k).awaitTermination(60)
    with Db(spark, f"file://{tmp_path}/db") as db:
        db.create_table([(1, 1)])
        start(db)
        assert db.snapshot().facts().count() == 100
        for name in os.listdir(f"{tmp_path}/cp/commits"):  # the stream failed after the database had the batch
            os.remove(f"{tmp_path}/cp/commits/{name}")
        start(db)
        assert db.snapshot().facts().count() == 100
        frame(spark, 90, 120, 3).unionByName(frame(spark, 110, 120, 3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start(db, late="drop")
        assert db.snapshot().facts().count() == 120 and db.state["sources"] == {f"{tmp_path}/cp": 1}
        frame(spark, 130, 131).unionByName(frame(spark, 130, 131).selectExpr("table_id", "series_id", "field_id", "ts", "kind", "cast(7 as decimal(20,0)) u", "q", "f")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with pytest.raises(Exception, match="occurs twice"):
            start(db)
    with Db(spark, f"file://{tmp_path}/db") as db:
        assert db.state["sources"] == {f"{tmp_path}/cp": 1}


def test_windowed_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.streaming.ingest import windowed

    frame(spark, 0, 600, 2).withColumn("at", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("table_id long, series_id long, field_id int, ts long, kind tinyint, u decimal(20,0), q smallint, f long, at timestamp").parquet(f"{tmp_path}/in")
    q = windowed(rows, "1 minute", "10 seconds").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("windowed").collect()
    assert len(got) == 20 and {r["sample_count"] for r in got} == {30} and sum(int(r["sum"]) for r in got) == sum(range(600))


def test_cli(spark, tmp_path):
    run = lambda *a: cli.run(spark, [a[0], f"file://{tmp_path}/db", *a[1:]])
    assert run("init") == ["ok"] and run("create-table", "1:uint", "2:f32", "--validity", "9") == ["1"]
    run("append", "1", "10", "7:1:u:5", "7:2:f:7fc01234")
    run("append", "1", "12", "7:1:null")
    assert run("scan", "1:7:1", "0", "20") == ["10\tu:5", "12\tnull"]
    assert run("value-at", "11", "1:7:1", "1:7:2", "1:8:1") == ["value\t10\tu:5", "value\t10\tf:7fc01234", "missing"]
    assert run("latest", "1:7:1") == ["null\t12"]
    assert run("seal") == ["1\t3"]
    assert run("aggregate", "0", "20", "20", "1:7:1") == ["0\t20\t2\t1\tu:5\tu:5\tu:5\tpartial"]
    assert run("sample", "10", "13", "2", "1:7:1") == ["10\tvalue\t10\tu:5\texact", "12\tnull\t12\texact"]
    assert run("compact", "l0") == ["0\t-"] and run("retain", "13") == ["1\t13"] and run("sync") == ["3"]
    assert run("maintain")[0].count("\t") == 4
    with pytest.raises(InvalidArgument):
        cli.parse_value("x:1")


def test_frames_of_keys_may_exceed_the_slots_of_a_list(spark, tmp_path, monkeypatch):
    from tidemark.scenarios import asked

    monkeypatch.setattr("tidemark.plans.guards.MAX_SLOTS", 10)
    with Db(spark, f"file://{tmp_path}/db") as db:
        t = db.create_table([(1, 1)])
        put(db, t, 1, *[(s, 1, U(s)) for s in range(4)])
        db.seal()
        put(db, t, 8, (9, 1, U(9)))  # pending streams are asked for too
        s, keys = db.snapshot(), [(t, k, 1) for k in (0, 1, 2, 3, 9)]
        for call in (s.aggregate, s.sample):
            with pytest.raises(ResourceExhausted):
                call(keys, 0, 9, 3)
            with pytest.raises(ResourceExhausted):
                call(asked(db, t), 0, 11, 1)
        out = s.aggregate(asked(db, t, 2), 0, 9, 3).collect()
        assert [(r["ord"], r["start_ts"], r["sum"]) for r in out] == [((k * 10 + 1) * 10 + i, 6 if k == 9 else 0, k) for k in (0, 1, 2, 3, 9) for i in (0, 1)]
        assert [(r["series_id"], r["slot_ts"], r["u"]) for r in s.sample(asked(db, t), 0, 9, 3).collect()] == [(k, ts, k if ts and k < 9 else None) for k in (0, 1, 2, 3, 9) for ts in (0, 3, 6)]
        with pytest.raises(InvalidArgument):
            s.sample(asked(db, t).withColumn("field_id", F.col("field_id") + 1), 0, 9, 3)


def test_few_facts_are_sealed_without_jobs(spark, tmp_path, monkeypatch):
    """The files that the driver writes have the digests that executors compute, and a catalogue of many units survives."""
    from tidemark.sources import units

    monkeypatch.setattr("tidemark.sources.manifest.PART", 2)
    root, sizes = f"file://{tmp_path}/db", []
    with Db(spark, root) as db:
        t = db.create_table([(1, 1), (2, 2), (3, 3)])
        spark.sparkContext.setJobGroup("sealing", "sealing")
        for ts in range(12):
            put(db, t, 10 * ts - 50, (1, 1, U(2**63 - 1 - ts)), (1, 2, Value.sq1(254)), (2**64 - 3, 3, Value.f32_bits(0xFFC01234)), (2**64 - 1, 1, NULL))
            put(db, t, 10 * ts - 49, (1, 1, U(ts)))
            db.seal()
            sizes.append(max(db.files.size(n) for n in db.files.list() if n.startswith("manifest-")))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("sealing")
        spark.sparkContext.setJobGroup("other", "other")
        assert max(sizes) < 1.7 * sizes[2]
        put(db, t, 1000, (1, 1, U(2**64 - 1)))  # does not fit a long, so a job writes it
        db.seal()
        assert db.verify() == 13
        rows = [tuple(r) for r in db.snapshot().facts().collect()]
        assert len(rows) == 61 and {r["u"] for r in db.snapshot().latest([(t, 1, 1)]).collect()} == {2**64 - 1}
        some = db.state["units"][:5]
        assert units.summaries(spark, [db.files.full(u["path"]) for u in some]) == {db.files.full(u["path"]): {k: u[k] for k in ("min_ts", "max_ts", "facts", "digest", "last_digest", "tables")} for u in some}
        before = db.state["units"]
    with Db(spark, root) as db:
        assert db.state["units"] == before
        assert sorted(tuple(r) for r in db.snapshot().facts().collect() if r["u"]) == sorted(r for r in rows if r[5])
        db.compact(0)
        assert len(db.state["units"]) == 1 and db.verify() == 1
    with Db(spark, root) as db:
        assert db.snapshot().facts().count() == 61
        put(db, t, 2000, (1, 1, U(1)))
        db.seal()
        assert not db.files.list("parts")


def test_positions_of_a_long_log(spark, tmp_path, monkeypatch):
    """A status reads no sizes of log files again."""
    with Db(spark, f"file://{tmp_path}/db") as db:
        t = db.create_table([(1, 1)])
        for ts in range(5):
            put(db, t, ts, (1, 1, U(ts)))
            db.sync()
        monkeypatch.setattr(db.files, "size", lambda n: pytest.fail("read again"))
        assert db.maintenance_status().wal_bytes > 0
        monkeypatch.undo()
        assert db.maintenance_status().wal_bytes == db.files.size("log")


def test_units_have_no_limit(spark, tmp_path):
    """Above the baseline's 8,192 live units seals go on, and all units are there when the database is opened again."""
    root = f"file://{tmp_path}/db"
    with Db(spark, root) as db:
        t = db.create_table([(1, 1)])
        put(db, t, 0, (1, 1, U(1)))
        db.seal()
        one = db.state["units"][0]  # rows of a catalogue alone: their files are not read here
        db.state["units"] += [one | {"id": k, "path": f"units/unit-{k:012d}-g{k}", "min_ts": k, "max_ts": k, "tables": {str(t): [k, k]}} for k in range(2, 8193)]
        db.state["next_unit"] = 8193
        for ts in (9000, 9001):
            put(db, t, ts, (1, 1, U(1)))
            assert db.seal().unit_id == ts - 807
        before = db.state["units"]
    with Db(spark, root) as db:
        assert db.state["units"] == before and len(before) == 8194
        assert db.maintenance_status().level_units == [8194, 0, 0] and db.snapshot().facts(9000).count() == 2


def test_many_units_are_listed_by_few_tasks(spark, tmp_path):
    """Compaction, and a view held over it, read many units without a task for each of their folders."""
    setting, tracker = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext.statusTracker()
    told, few = spark.conf.get(setting), 4 * spark.sparkContext.defaultParallelism
    with Db(spark, f"file://{tmp_path}/db") as db:
        t = db.create_table([(1, 1)])
        for ts in range(3 * few):
            put(db, t, ts, (ts % 5, 1, U(ts)))
            db.seal()
        spark.sparkContext.setJobGroup("listing", "listing")
        view = db.snapshot()
        assert db.compact(0).input_units == 3 * few and db.verify() == 1
        assert sorted(int(r["u"]) for r in view.facts().collect()) == sorted(int(r["u"]) for r in db.snapshot().facts().collect()) == list(range(3 * few))
        assert len(db.files.list("units")) == 3 * few + 1
        stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        spark.sparkContext.setJobGroup("other", "other")
        assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= few
        assert spark.conf.get(setting) == told
        del view
        db._cached = None
        db._collect()
        assert len(db.files.list("units")) == 1
