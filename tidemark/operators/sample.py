"""Fixed-step sampling with carry-forward bounded by validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEY, VALUE
from ..plans.guards import check_range, check_step, slots
from .visibility import visible


def sample(facts: DataFrame, keys: DataFrame, start: int, end: int, step: int, n_keys: int, versions=None, retired_series=None, retired_fields=None, heads: DataFrame | None = None, ticks: int = 1, floor: int | None = None) -> DataFrame:
    """One row a requested key and slot start + i * step < end: state value, null or gap, the value, its time, ``carried``.

    Only the newest fact before each slot can show there, so a partial
    aggregation leaves at most one row a stream and slot (all within the slot
    limit, however many facts a stream has); these and the slots meet in one window.
    """
    check_range(start, end, floor)
    check_step(step, "step")
    slots(start, end, step, n_keys)
    asked = keys.select(*KEY).distinct()
    rows = facts.select(*KEY, "ts", *VALUE).join(asked, KEY).where(F.col("ts") < end)
    if heads is not None:
        rows = rows.unionByName(heads.select(*KEY, "ts", *VALUE).join(asked, KEY))
    slot = F.greatest(F.lit(0).cast("long"), F.expr(f"(ts - {start}L + {step - 1}L) div {step}L"))  # the first slot at or after the fact
    slot = F.when(F.col("ts") <= start, F.lit(0).cast("long")).otherwise(slot)
    newest = rows.withColumn("slot", slot).groupBy(*KEY, "slot").agg(*[F.max_by(v, "ts").alias(v) for v in VALUE], F.max("ts").alias("at_ts"))
    fact = F.struct("at_ts", *VALUE)
    rows = newest.select(*KEY, (F.lit(start).cast("long") + F.col("slot") * step).alias("ts"), F.lit(0).alias("grid"), fact.alias("fact"))
    if start < end:
        grid = asked.withColumn("ts", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"), F.lit(step).cast("long"))))
    else:
        grid = asked.withColumn("ts", F.lit(start).cast("long")).where("false")
    grid = grid.select(*KEY, "ts", F.lit(1).alias("grid"), F.lit(None).cast(rows.schema["fact"].dataType).alias("fact"))
    over = W.partitionBy(*KEY).orderBy("ts", "grid").rowsBetween(W.unboundedPreceding, 0)
    at = rows.unionByName(grid).withColumn("fact", F.last("fact", ignorenulls=True).over(over)).where("grid = 1")
    at = at.select(*KEY, F.col("ts").alias("t"), "fact.*")
    at = visible(at, versions, retired_series, retired_fields, ticks)
    state = F.when(~F.col("live"), "gap").when(F.col("kind") == 0, "null").otherwise("value")
    at = at.withColumn("state", state)
    shown = lambda c: F.when(F.col("live"), F.col(c)).alias(c)
    at = at.select(*KEY, F.col("t").alias("slot_ts"), "state", *[shown(v) for v in VALUE], shown("at_ts"), F.when(F.col("live"), F.col("at_ts") < F.col("t")).alias("carried"))
    return keys.join(at, KEY).select("ord", *KEY, "slot_ts", "state", *VALUE, F.col("at_ts").alias("source_ts"), "carried")
