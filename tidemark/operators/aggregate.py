"""Tumbling buckets anchored at the start of the range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import F32, SQ1, UINT, order_key, sq1_fp4
from ..model import KEY
from ..plans.guards import check_range, check_step


def aggregate(facts: DataFrame, keys: DataFrame, tables: DataFrame, start: int, end: int, width: int, floor: int | None = None, fields: DataFrame | None = None) -> DataFrame:
    """One row a requested key and bucket that has facts in [start, end).

    sample_count and null_count; min and max as raw values (u, q, f) by the type's
    order; ``sum`` (exact; of codes as percent x 10^4; null for floats; 0 if all
    are null); ``is_partial`` if the bucket is cut by the range's end or the
    table's clock has not reached its end.  No validity, no retirement.
    ``fields`` (table_id, field_id, value_type) names the type of buckets that hold nulls alone.
    """
    check_range(start, end, floor)
    check_step(width, "width")
    asked = keys.select(*KEY).distinct()
    bucket = F.expr(f"(ts - {start}L) div {width}L")
    rows = facts.where((F.col("ts") >= start) & (F.col("ts") < end)).select(*KEY, bucket.alias("bucket"), "kind", "u", "q", "f").join(asked, KEY)
    rows = rows.withColumn("_o", order_key(F.col("kind"))).withColumn(
        "_n", F.when(F.col("kind") == UINT, F.col("u").cast("decimal(38,0)")).when(F.col("kind") == SQ1, sq1_fp4(F.col("q")).cast("decimal(38,0)"))
    )
    live = F.col("kind") != 0
    ends = lambda pick, name: [pick(c, "_o").alias(f"{name}_{c}") for c in ("u", "q", "f")]
    out = rows.groupBy(*KEY, "bucket").agg(
        F.count("*").alias("sample_count"), F.count_if(~live).alias("null_count"), *ends(F.min_by, "min"), *ends(F.max_by, "max"),
        F.sum("_n").alias("_sum"), F.max("kind").alias("kind"),
    )
    out = out.join(tables.select("table_id", "last_ts"), "table_id", "left")
    kind = F.col("kind")
    if fields is not None:
        out = out.join(fields.select("table_id", "field_id", "value_type"), ["table_id", "field_id"], "left")
        kind = F.coalesce(F.col("value_type"), kind)
    natural = F.lit(start).cast("long") + (F.col("bucket") + 1) * width
    out = out.withColumn("start_ts", F.lit(start).cast("long") + F.col("bucket") * width).withColumn("end_ts", F.least(natural, F.lit(end).cast("long")))
    out = out.withColumn("is_partial", (natural > end) | (F.col("last_ts") < F.col("end_ts"))).withColumn(
        "sum", F.when(kind != F32, F.coalesce("_sum", F.lit(0).cast("decimal(38,0)")))
    )
    cols = ["start_ts", "end_ts", "sample_count", "null_count", "kind", *[f"{m}_{c}" for m in ("min", "max") for c in ("u", "q", "f")], "sum", "is_partial"]
    return keys.join(out, KEY).select("ord", *KEY, *cols)
