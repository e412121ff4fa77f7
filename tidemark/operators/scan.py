"""Raw facts of streams in a time range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.guards import check_range


def scan(facts: DataFrame, table_id: int, series_id: int, field_id: int, start: int, end: int, floor: int | None = None) -> DataFrame:
    """Facts of one stream in [start, end), ascending; explicit nulls included; no validity, no retirement."""
    check_range(start, end, floor)
    key = (F.col("table_id") == table_id) & (F.col("series_id") == series_id) & (F.col("field_id") == field_id)
    return facts.where(key & (F.col("ts") >= start) & (F.col("ts") < end)).orderBy("ts")
