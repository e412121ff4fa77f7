"""As-of lookups: the nearest fact at or before a time, if it is visible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY, VALUE
from .visibility import visible


def nearest(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (distinct keys and t) with the newest fact of the key at or before t.

    One partial aggregation before the only shuffle.  Spark sees the request's size
    and broadcasts it while it is small, so the facts stay where they are.
    """
    hit = facts.select(*KEY, "ts", *VALUE).join(asked, KEY).where("ts <= t")
    best = hit.groupBy(*KEY, "t").agg(*[F.max_by(v, "ts").alias(v) for v in VALUE], F.max("ts").alias("at_ts"))
    return asked.join(best, [*KEY, "t"], "left")


def value_at(facts: DataFrame, keys: DataFrame, t: int, versions=None, retired_series=None, retired_fields=None, heads: DataFrame | None = None, ticks: int = 1) -> DataFrame:
    """One row a requested key (``ord``, repeats allowed): state value, null or missing, the value and its time."""
    return _lookup(facts, keys.withColumn("t", F.lit(t).cast("long")), versions, retired_series, retired_fields, heads, ticks)


def latest(facts: DataFrame, keys: DataFrame, tables: DataFrame, versions=None, retired_series=None, retired_fields=None, heads: DataFrame | None = None, ticks: int = 1) -> DataFrame:
    """``value_at`` at each table's last timestamp; tables without rows have nothing."""
    clock = tables.select("table_id", F.col("last_ts").alias("t"))
    return _lookup(facts, keys.join(clock, "table_id", "left"), versions, retired_series, retired_fields, heads, ticks)


def _lookup(facts, keys, versions, retired_series, retired_fields, heads, ticks):
    if heads is not None:  # older than any surviving fact of their stream
        facts = facts.select(*KEY, "ts", *VALUE).unionByName(heads.select(*KEY, "ts", *VALUE))
    asked = keys.select(*KEY, "t").distinct()
    found = visible(nearest(facts, asked.where("t is not null")), versions, retired_series, retired_fields, ticks)
    found = found.where("live").select(*KEY, "t", *VALUE, "at_ts")
    out = keys.join(found, [*KEY, "t"], "left")
    state = F.when(F.col("at_ts").isNull(), "missing").when(F.col("kind") == 0, "null").otherwise("value")
    return out.select("ord", *KEY, state.alias("state"), *VALUE, "at_ts")
