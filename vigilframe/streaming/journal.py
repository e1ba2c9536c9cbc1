"""The journal as a stream: sealed events are opened and folded per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilframe.sources import journal


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(journal.SCHEMA).parquet(path)


def assessment_totals(events: DataFrame, key: bytes, salt_epoch: str) -> DataFrame:
    """Running fold of every person's assessments: all of its parts are maxima."""
    opened = journal.assessments(journal.readable(events, key, salt_epoch))
    return opened.groupBy("pid").agg(
        F.count("*").alias("events"), F.max("total").alias("total"),
        F.max_by("acute", "seq").alias("acute"))


def follow(events: DataFrame, key: bytes, salt_epoch: str,
           sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Update mode: each batch hands over the people whose fold changed."""
    return (assessment_totals(events, key, salt_epoch).writeStream.outputMode("update")
            .foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
