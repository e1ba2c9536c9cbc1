"""Mergeable daily store: partial sums of signals, appended in any order and merged where they are read.

A row holds the sum, the count and the last sight of one person, domain, day and unit in one batch, in
the folder ``day=D/batch=N/compact=0``.  A batch owns its folders: a batch that is handed over again
replaces them, so nothing counts twice, and a row that comes ten days late is one more small file in the
folder of its own day.  Readers add up the parts of the days they need, which the folder names prune.

``compact`` adds up the parts of a day into one, named after the last batch it contains
(``compact=1``); whatever it contains is no longer read, and ``tidy`` deletes it.  A compaction that is
interrupted leaves files that its repetition replaces.  ``age_out`` drops whole days by their folders.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.operators.features import daily_parts

SCHEMA = ("pid STRING, domain STRING, unit_id STRING, total DOUBLE, n BIGINT, seen TIMESTAMP, "
          "day DATE, batch BIGINT, compact INT")
FOLDERS = ("day", "batch", "compact")


def append(signals: DataFrame, path: str, batch: int) -> None:
    """Add the rows of one batch; the same batch again replaces them."""
    parts = daily_parts(signals).withColumns({
        "seen": F.col("seen").cast("timestamp"), "batch": F.lit(batch).cast("bigint"), "compact": F.lit(0)})
    _write(parts, path)


def _write(parts: DataFrame, path: str) -> None:
    # a day's rows to one task each: a file for each day, however many tasks summed
    (parts.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*FOLDERS).parquet(path))


def stored(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Every part that counts, of the days from ``first`` to ``last``."""
    parts = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        parts = parts.where(F.col("day") >= F.lit(first))
    if last is not None:
        parts = parts.where(F.col("day") <= F.lit(last))
    return _counting(parts).drop(*FOLDERS[1:])


def _counting(parts: DataFrame) -> DataFrame:
    """Without the parts that a compaction contains."""
    return parts.join(_contained(parts), "day", "left").where(
        F.col("upto").isNull() | (F.col("batch") > F.col("upto"))
        | ((F.col("batch") == F.col("upto")) & (F.col("compact") == 1))).drop("upto")


def _contained(parts: DataFrame) -> DataFrame:
    """Per compacted day the last batch its sum contains: a row a day."""
    return parts.where("compact = 1").groupBy("day").agg(F.max("batch").alias("upto"))


def merged(parts: DataFrame) -> DataFrame:
    """Parts -> one row per person, domain, day and unit, as ``features.daily_parts`` makes of raw rows."""
    return parts.groupBy("pid", "domain", "day", "unit_id").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("seen").alias("seen"))


def history(spark: SparkSession, path: str, as_of: date, days: int) -> DataFrame:
    """The merged parts of the ``days`` days up to ``as_of``."""
    return merged(stored(spark, path, as_of - timedelta(days=days - 1), as_of))


def compact(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """Add up the days that lie in ``least`` parts or more; returns (day, parts) of what was done."""
    counted = _counting(spark.read.schema(SCHEMA).parquet(path)).groupBy("day").agg(
        F.count_distinct("batch", "compact").alias("parts"), F.max("batch").alias("batch"))
    todo = spark.createDataFrame(  # a row a day: the days in store, not the rows
        counted.where(F.col("parts") >= least).collect(), "day DATE, parts BIGINT, batch BIGINT")
    days = [r.day for r in todo.collect()]
    if days:
        some = stored(spark, path, min(days), max(days)).join(F.broadcast(todo.select("day", "batch")), "day")
        _write(some.groupBy("pid", "domain", "day", "unit_id", "batch").agg(
            F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("seen").alias("seen")).withColumn(
            "compact", F.lit(1)), path)
    return todo.select("day", "parts")


def _folders(spark: SparkSession, path: str):
    """(file system, folder) of every day."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in files.listStatus(where):
        if entry.getPath().getName().startswith("day="):
            yield files, entry.getPath()


def tidy(spark: SparkSession, path: str) -> int:
    """Delete the parts that a compaction contains; returns how many folders went."""
    upto = {str(r.day): r.upto for r in _contained(spark.read.schema(SCHEMA).parquet(path)).collect()}
    gone = 0
    for files, day in _folders(spark, path):
        for entry in files.listStatus(day):
            name, last = entry.getPath().getName(), upto.get(day.getName()[4:])
            if not name.startswith("batch=") or last is None or int(name[6:]) > last:
                continue
            if int(name[6:]) < last:
                gone += files.delete(entry.getPath(), True)
            else:  # the last batch shares its folder with the sum
                raw = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "compact=0")
                gone += files.exists(raw) and files.delete(raw, True)
    return gone


def age_out(spark: SparkSession, path: str, as_of: date, keep_days: int) -> DataFrame:
    """Drop the days before ``as_of - keep_days`` by their folders; returns (day, rows) of what went."""
    border = as_of - timedelta(days=keep_days)
    old = stored(spark, path, last=border - timedelta(days=1)).groupBy("day").agg(F.sum("n").alias("rows"))
    removed = spark.createDataFrame(old.collect(), "day DATE, rows BIGINT")
    for files, day in _folders(spark, path):
        if day.getName()[4:] < border.isoformat():
            files.delete(day, True)
    return removed
