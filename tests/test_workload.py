from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.db import Db
from tidemark.sources import workload


def test_month_invariants(spark):
    m = workload.host_month(spark).persist()
    count = {(r["table_id"], r["series_id"], r["field_id"]): (r["n"], r["z"] / r["n"]) for r in m.groupBy("table_id", "series_id", "field_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == 0).alias("z")).collect()}
    assert [count[(2, r, 1)][0] for r in (1, 2, 3)] == [172_800] * 3
    loss = [count[(2, r, 1)][1] for r in (1, 2, 3)]
    assert 0.01 < loss[0] < loss[1] < loss[2] < 0.2
    assert count[(4, 1, 3)][0] == 4  # the first sample and three restarts
    sizes = m.where("(table_id = 1 and field_id >= 5) or table_id = 3").where(F.col("u") % 10_000_000 != 0)
    assert sizes.isEmpty()
    boots = sorted(r["ts"] for r in m.where("table_id = 4 and field_id = 3").collect())
    run = m.where("table_id = 1 and field_id in (6, 7)").withColumn("boot", sum((F.col("ts") >= b).cast("int") for b in boots))
    step = run.withColumn("d", F.col("u") - F.lag("u").over(W.partitionBy("field_id", "boot").orderBy("ts")))
    assert step.where("d < 0").isEmpty()
    m.unpersist()


def test_day_in_a_database(spark, tmp_path):
    with Db(spark, f"file://{tmp_path}/db") as db:
        for fields, validity in workload.TABLES:
            db.create_table(fields, validity)
        day = workload.host_month(spark, days=1)
        db.append_frame(day)
        s = db.snapshot()
        end = workload.START + 86_400
        assert s.aggregate([(1, 1, 1)], workload.START, end, 3600).count() == 24
        total = s.aggregate([(2, r, 1) for r in (1, 2, 3)], workload.START, end, 86_400).collect()
        assert [r["sample_count"] for r in total] == [5760] * 3 and all(r["is_partial"] for r in total)
        assert s.sample([(1, 1, 2)], workload.START, end, 60).where("state = 'gap'").count() == 0
        assert s.latest([(4, 1, 1)]).first()["u"] == 16_000_000_000


def test_numbers_next_to_a_multiple_are_not_rounded_up(spark):
    """Halves of 2^32 - 1 and fractions above 0.9999995 round up to the next whole number at six digits."""
    near = [0x1E3779B97F4A7C15, 335_006, 4_300_000_000]

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        for by, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ x >> by) * k) % 2**64
        return x ^ x >> 31

    def before(d):
        """The number whose first fold is d."""
        x = d
        for _ in range(3):
            x = d ^ x >> 30
        return (x - 0x9E3779B97F4A7C15) % 2**64

    near += [before(h << 32 | 0xFFFFFFFF - k) for h in (0, 1, 77, 2**31) for k in (0, 1, 2000)]
    near = [n - 2**64 if n >= 2**63 else n for n in near]
    rows = spark.createDataFrame([(n,) for n in near if n >= 0], "n long").select("n", workload.splitmix(F.col("n")).alias("m")).collect()
    assert len(rows) > 5 and [int(r["m"]) for r in rows] == [mix(r["n"]) for r in rows]
    span, at = 2_999_999_999, [0, 2_999_999_998, 2_999_999_999, 5_999_999_997]
    for sign in (1, -1):
        out = spark.createDataFrame([(a,) for a in at], "a long").select(workload.lerp(F.lit(10), F.lit(10 + sign), F.col("a"), F.lit(span)).alias("x")).collect()
        assert [r["x"] for r in out] == [10 + sign * (a // span) for a in at]
    assert spark.range(1).select(workload.lerp(F.lit(1), F.lit(2), F.col("id"), F.lit(0)).alias("x")).first()["x"] is None
