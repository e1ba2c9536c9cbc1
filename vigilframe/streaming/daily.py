"""Signals as they arrive, collapsed to one value per person, domain and day.

``append_daily`` publishes days that are finished: a row later than LATE_BY is not in it.  ``into_store``
keeps every row, however late, in the mergeable store that the nightly run reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilframe.sources import daily_store

LATE_BY = "2 days"


def daily_values(signals: DataFrame) -> DataFrame:
    """Tumbling days with a watermark; rows later than that are only in the store."""
    return (
        signals.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
        .withWatermark("observed_at", LATE_BY)
        .groupBy(F.window("observed_at", "1 day"), "pid", "domain")
        .agg(F.avg("value").alias("value"), F.count("*").alias("rows"))
        .select("pid", "domain", F.to_date("window.start").alias("day"), "value", "rows"))


def append_daily(signals: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append finished days to a table partitioned by day."""
    return (daily_values(signals).writeStream.outputMode("append").format("parquet")
            .option("path", table).option("checkpointLocation", checkpoint)
            .partitionBy("day").trigger(availableNow=True).start())


def into_store(signals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch adds its partial sums to the days it touches, late ones included."""
    return (signals.writeStream.foreachBatch(lambda rows, batch: daily_store.append(rows, path, batch))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
