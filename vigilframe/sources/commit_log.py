"""Write-ahead log in two steps: rows first, then a manifest that commits them.

A batch's rows lie in ``rows/batch=N`` and count only once ``commits/batch=N`` holds their number and the
sum of their hashes, written after them.  A batch that failed in between, or whose files were changed or
lost since, is not committed: readers never see it, and handing it over again replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch BIGINT, n BIGINT, mark DECIMAL(38,0)"


def _mark(columns: list[str]) -> Column:
    """Sum of row hashes: the same in any order of rows and files."""
    return F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(20,0)")), F.lit(0)).cast(
        "decimal(38,0)")


def append(rows: DataFrame, path: str, batch: int) -> None:
    """Write the rows of one batch, read them back, and commit what was found."""
    where = f"{path}/rows/batch={batch}"
    rows.write.mode("overwrite").parquet(where)
    written = rows.sparkSession.read.schema(rows.schema).parquet(where)
    found = written.agg(F.count("*").alias("n"), _mark(rows.columns).alias("mark"))
    found.select(F.lit(rows.schema.json()).alias("layout"), "n", "mark").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/commits/batch={batch}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of committed batches, with their ``batch``; one number of batches is compared per batch."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/rows").withColumn("batch", F.col("batch").cast("bigint"))
    names = [c for c in rows.columns if c != "batch"]
    manifest = spark.read.schema(f"layout STRING, {MANIFEST}").parquet(f"{path}/commits").select("batch", "n", "mark")
    found = rows.groupBy("batch").agg(F.count("*").alias("n"), _mark(names).alias("mark"))
    return rows.join(manifest.join(found, ["batch", "n", "mark"]).select("batch"), "batch", "left_semi")
