"""Facts from other tables: any DataFrame with a stream id, a field, a time and a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import F32, SQ1, UINT, f32_bits, sq1_quantize

#: The fields that event types become.
EVENT_FIELDS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def to_facts(df: DataFrame, series: Column, field: Column, ts: Column, value: Column, kind: int, is_null: Column | None = None, table_id: int = 1, version_no: int = 1, seq: Column | None = None) -> DataFrame:
    """``df`` as long facts; a null value, or ``is_null``, is an explicit null."""
    none = value.isNull() if is_null is None else is_null | value.isNull()
    only = lambda k, c, t: F.when(~none, c).cast(t) if kind == k else F.lit(None).cast(t)
    return df.select(
        F.lit(table_id).cast("long").alias("table_id"), series.cast("long").alias("series_id"), field.cast("int").alias("field_id"), ts.cast("long").alias("ts"),
        F.lit(version_no).alias("version_no"), F.when(none, 0).otherwise(kind).cast("tinyint").alias("kind"),
        only(UINT, value, "decimal(20,0)").alias("u"), only(SQ1, value, "smallint").alias("q"), only(F32, value, "long").alias("f"),
        (seq if seq is not None else F.lit(0)).cast("long").alias("seq"),
    )


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def event_facts(spark: SparkSession, sf_dir: str, kind: int = UINT, nulls: bool = True) -> DataFrame:
    """The events table: users are series, event types fields, cents unsigned integers (or the value as code or float)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    field = F.lit(None)
    for name, i in EVENT_FIELDS.items():
        field = F.when(F.col("event_type") == name, i).otherwise(field)
    value = {
        UINT: F.round(F.col("value") * 100).cast("long"),
        SQ1: sq1_quantize(F.least(F.floor(F.col("value") * 20), F.lit(10000))),
        F32: f32_bits(F.col("value")) if kind == F32 else None,
    }[kind]
    none = F.col("event_id") % 11 == 0 if nulls else None
    return to_facts(e, F.col("user_id"), field, micros(F.col("ts")), value, kind, none, seq=F.col("event_id"))
