"""Lifecycle plans as DataFrame queries: ingest checks and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY, VALUE
from ..operators.visibility import visible


def schema_violations(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """Facts whose field is unknown, or whose value is not of the field's type; explicit nulls fit every type."""
    known = fields.select("table_id", "field_id", "value_type")  # a local table, so its size is known
    reason = F.when(F.col("value_type").isNull(), "unknown field").when((F.col("kind") != 0) & (F.col("kind") != F.col("value_type")), "type mismatch")
    return facts.join(known, ["table_id", "field_id"], "left").withColumn("reason", reason).where("reason is not null").drop("value_type")


def retention_heads(expired: DataFrame, floor: int | None, versions=None, retired_series=None, retired_fields=None, prior: DataFrame | None = None, ticks: int = 1) -> DataFrame:
    """The last fact of each stream among ``expired`` facts and ``prior`` heads, if it is visible at the floor."""
    rows = expired.select(*KEY, "ts", *VALUE)
    if prior is not None:
        rows = rows.unionByName(prior.select(*KEY, "ts", *VALUE))
    best = rows.groupBy(*KEY).agg(*[F.max_by(v, "ts").alias(v) for v in VALUE], F.max("ts").alias("at_ts"))
    best = visible(best.withColumn("t", F.lit(floor).cast("long")), versions, retired_series, retired_fields, ticks)
    return best.where("live").select(*KEY, F.col("at_ts").alias("ts"), *VALUE)
