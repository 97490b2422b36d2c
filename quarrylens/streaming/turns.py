"""Conversation turns as a stream: each micro-batch is upserted into a table by key; also windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylens.functions.scalars import latest


def upsert_stream(turns: DataFrame, table: str, checkpoint: str, key: str = "id", order: str = "asked_at", once: bool = True) -> StreamingQuery:
    """Writes versions of the table under table/v=N; the newest version is the table.

    A batch that is replayed after a failure writes the same version again, so each turn counts once.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col(key).isNotNull())
        if n > 0:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{table}/v={n - 1}"))
        latest(rows, [key], [order]).write.mode("overwrite").parquet(f"{table}/v={n}")

    w = turns.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, by, n, total for tumbling windows; rows later than the watermark are dropped by the engine."""
    w = F.window(F.col(ts), width)
    return events.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "total")
