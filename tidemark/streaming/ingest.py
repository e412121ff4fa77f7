"""Structured Streaming into a database: every micro-batch passes the same checks as any other ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..db import Db
from ..model import KEY


def stream_into(facts: DataFrame, db: Db, checkpoint: str, late: str = "reject", name: str | None = None, **trigger):
    """Starts a query that appends a stream of facts, each batch once.

    The database keeps the number of the last batch of ``name`` (the checkpoint's
    path unless given) with the batch's facts, in one commit, so a batch that is sent
    again after a failure is not taken again.  Rows that are equal in all
    columns count once; two different facts of a stream at one time stop the
    query.  ``late`` rows (not after the table's clock) stop it too, or with "drop"
    are left out, as a watermark would.
    """
    source = name or checkpoint

    def batch(rows: DataFrame, number: int) -> None:
        if db.state["sources"].get(source, -1) >= number:
            return
        rows = rows.select(*KEY, "ts", "kind", "u", "q", "f").distinct()
        if late == "drop":
            clock = db.snapshot().tables_frame()
            rows = rows.join(clock, "table_id").where("last_ts is null or ts > last_ts").drop("last_ts")
        rows = rows.persist()
        try:
            db.append_frame(rows, (source, number))
        finally:
            rows.unpersist()

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(facts: DataFrame, width: str, watermark: str) -> DataFrame:
    """Tumbling counts and exact sums of unsigned values on event time for a stream with a TIMESTAMP column ``at``."""
    return facts.withWatermark("at", watermark).groupBy(F.window("at", width), *KEY).agg(
        F.count("*").alias("sample_count"), F.count_if(F.col("kind") == 0).alias("null_count"), F.sum(F.col("u").cast("decimal(38,0)")).alias("sum")
    ).select(*KEY, F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), "sample_count", "null_count", "sum")
