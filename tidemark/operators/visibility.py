"""Which fact counts at a time: validity of its version and retirement of its series or field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def visible(found: DataFrame, versions: DataFrame | None = None, retired_series: DataFrame | None = None, retired_fields: DataFrame | None = None, ticks: int = 1) -> DataFrame:
    """``found`` (table_id, series_id, field_id, t, at_ts, ...) with ``live``.

    Not live: nothing found; retired at or after the fact and before t; as old as the
    validity of the version active at the fact.  A fact before every version of
    its table is corruption, an error when the rows are read.  The catalogue tables
    hold one row a version, series or field.
    """
    cutoffs = []
    if retired_series is not None:
        found = found.join(retired_series.select("table_id", "series_id", F.col("cutoff").alias("_rs")), ["table_id", "series_id"], "left")
        cutoffs.append("_rs")
    if retired_fields is not None:
        found = found.join(retired_fields.select("table_id", "field_id", F.col("cutoff").alias("_rf")), ["table_id", "field_id"], "left")
        cutoffs.append("_rf")
    live = F.col("at_ts").isNotNull() & (F.col("t") >= F.col("at_ts"))
    if cutoffs:
        cut = F.greatest(*cutoffs) if len(cutoffs) > 1 else F.col(cutoffs[0])
        live = live & ~F.coalesce((F.col("t") > cut) & (F.col("at_ts") <= cut), F.lit(False))
    if versions is not None:
        v = versions.select(F.col("table_id").alias("_vt"), "effective_from", "effective_to", "validity_s")
        inside = (F.col("table_id") == F.col("_vt")) & (F.col("at_ts") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("at_ts") < F.col("effective_to")))
        found = found.join(v, inside, "left")
        age = F.col("t").cast(WIDE) - F.col("at_ts").cast(WIDE)
        lost = F.col("at_ts").isNotNull() & F.col("_vt").isNull()
        found = found.withColumn("at_ts", F.when(lost, F.raise_error(F.concat(F.lit("corruption: no version is active at "), F.col("at_ts").cast("string"))).cast("long")).otherwise(F.col("at_ts")))
        live = live & (F.col("validity_s").isNull() | (age < F.col("validity_s").cast(WIDE) * ticks))
        cutoffs += ["_vt", "effective_from", "effective_to", "validity_s"]
    return found.withColumn("live", F.coalesce(live, F.lit(False))).drop(*cutoffs)
