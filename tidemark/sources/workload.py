"""A month of one host's metrics, generated by executors: test data with the shape of server monitoring.

Four tables: 1 ``high`` every 3 s (cpu as code, three loads x 100, memory bytes, network counters), 2 ``ping`` every
15 s (milliseconds of three routes, or null for a loss), 3 ``disk`` every minute (used bytes), 4 ``event`` at the first sample
and every restart (capacities and boot time).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import SQ1, UINT, sq1_quantize

START, CADENCE, TEN_MB = 1_700_000_000, 3, 10_000_000
#: (fields with types, validity in seconds or None) of tables 1 to 4.
TABLES = (
    ([(1, SQ1), (2, UINT), (3, UINT), (4, UINT), (5, UINT), (6, UINT), (7, UINT)], 9),
    ([(1, UINT)], 45),
    ([(1, UINT)], 180),
    ([(1, UINT), (2, UINT), (3, UINT)], None),
)
LOSSES = (0.02, 0.06, 0.14)


def chance(salt: int) -> Column:
    """A number in [0, 1) that depends on the sample and the salt alone."""
    return F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(1_000_000)) / F.lit(1_000_000.0)


def lerp(start: Column, end: Column, position: Column, span: Column) -> Column:
    """The whole number at ``position`` of ``span`` on the way from start to end, cut towards zero."""
    wide = lambda c: c.cast("decimal(38,0)")
    way = (wide(end - start) * position).cast("decimal(38,0)")
    # a quotient is rounded to six digits, so only what divides evenly is divided
    return start + F.try_divide((way - F.try_mod(way, wide(span))).cast("decimal(38,0)"), wide(span)).cast("long")


def splitmix(value: Column) -> Column:
    """A scrambled unsigned 64-bit number as DECIMAL(20,0): a weak but fast generator's step.  Arithmetic is modulo 2^64, in halves."""
    number = lambda n: F.lit(Decimal(n)).cast("decimal(38,0)")
    let = lambda c, f: F.element_at(F.transform(F.array(c.cast("decimal(38,0)")), f), 1)  # noqa: E731  an expression used twice is written once

    def times(d: Column, k: int) -> Column:
        low = d % number(2**32)
        high = ((d - low).cast("decimal(38,0)") / number(2**32)).cast("decimal(38,0)")  # divides evenly: a quotient is rounded to six digits
        cross = (low * number(k >> 32)) % number(2**32) + (high * number(k % 2**32)) % number(2**32)
        return ((cross.cast("decimal(38,0)") % number(2**32)) * number(2**32)).cast("decimal(38,0)") + (low * number(k % 2**32)).cast("decimal(38,0)")

    def fold(d: Column, by: int) -> Column:
        signed = F.when(d >= number(2**63), d - number(2**64)).otherwise(d).cast("long")
        mixed = F.element_at(F.transform(F.array(signed), lambda n: n.bitwiseXOR(F.shiftrightunsigned(n, by))), 1).cast("decimal(38,0)")
        return let(mixed, lambda m: F.when(m < 0, m + number(2**64)).otherwise(m).cast("decimal(38,0)"))

    out = let(value, lambda v: (v + number(0x9E3779B97F4A7C15)) % number(2**64))
    stage = lambda c, by, k: let(let(c, lambda d: fold(d, by)), lambda d: times(d, k).cast("decimal(38,0)") % number(2**64))
    out = stage(stage(out, 30, 0xBF58476D1CE4E5B9), 27, 0x94D049BB133111EB)
    return let(out, lambda d: fold(d, 31)).cast("decimal(20,0)")


def rounded(b: Column) -> Column:
    return (F.round(b / TEN_MB) * TEN_MB).cast("long")


def host_month(spark: SparkSession, days: int = 30, restarts: int = 3) -> DataFrame:
    """Facts (table_id, series_id, field_id, ts, kind, u, q, f)."""
    n = days * 86_400 // CADENCE
    every = n // (restarts + 1)
    base = spark.range(n).withColumnRenamed("id", "i").withColumn("ts", F.lit(START) + F.col("i") * CADENCE)
    up = (F.least((F.col("i") / every).cast("long"), F.lit(restarts)) * every).alias("boot")
    base = base.withColumn("boot", up)
    day = F.sin(F.col("i") * (2 * 3.141592653589793 * CADENCE / 86_400))
    since = (F.col("i") - F.col("boot")) * CADENCE
    basis_points = F.least(F.greatest(2000 + 1500 * day + 2500 * chance(1) * chance(2), F.lit(0)), F.lit(10_000)).cast("long")
    counter = lambda rate, salt: rounded(since * rate + chance(salt) * (rate * CADENCE))  # noqa: E731  steps are never negative

    def facts(rows: DataFrame, table: int, series: int, field: int, value: Column, kind: int = UINT) -> DataFrame:
        none = value.isNull()
        return rows.select(
            F.lit(table).cast("long").alias("table_id"), F.lit(series).cast("long").alias("series_id"), F.lit(field).alias("field_id"), "ts",
            F.when(none, 0).otherwise(kind).cast("tinyint").alias("kind"), (value if kind == UINT else F.lit(None)).cast("decimal(20,0)").alias("u"),
            (value if kind == SQ1 else F.lit(None)).cast("smallint").alias("q"), F.lit(None).cast("long").alias("f"),
        )

    out = facts(base, 1, 1, 1, sq1_quantize(basis_points), SQ1)
    for field, salt in ((2, 3), (3, 4), (4, 5)):
        out = out.unionByName(facts(base, 1, 1, field, (F.lit(100) + 60 * day + 80 * chance(salt)).cast("long")))
    out = out.unionByName(facts(base, 1, 1, 5, rounded(F.lit(6e9) + 2e9 * day + 5e8 * chance(6))))
    out = out.unionByName(facts(base, 1, 1, 6, counter(400_000, 7))).unionByName(facts(base, 1, 1, 7, counter(150_000, 8)))
    ping = base.where("i % 5 = 0")
    for route, loss in enumerate(LOSSES, 1):
        out = out.unionByName(facts(ping, 2, route, 1, F.when(chance(20 + route) >= loss, (8 * route + 30 * chance(10 + route)).cast("long"))))
    out = out.unionByName(facts(base.where("i % 20 = 0"), 3, 1, 1, rounded(lerp(F.lit(80_000_000_000), F.lit(90_368_000_000), F.col("i"), F.lit(n)))))
    boot = base.where("i = boot")
    for field, value in ((1, F.lit(16_000_000_000)), (2, F.lit(250_000_000_000)), (3, F.col("ts"))):
        out = out.unionByName(facts(boot, 4, 1, field, value))
    return out
