"""Named queries: (spark, folder of parquet tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict):
    def query(self, fn: Query) -> Query:
        if fn.__name__ in self:
            raise ValueError(f"query {fn.__name__} is registered twice")

        @wraps(fn)
        def in_utc(spark: SparkSession, folder: str) -> DataFrame:
            # days, windows and literals are all read as UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        self[fn.__name__] = in_utc
        return fn


def r9(name: str, alias: str | None = None) -> Column:
    """Round at output only: sums of doubles have no fixed order on a cluster."""
    return F.round(F.col(name).cast("double"), 9).alias(alias or name)


def day(name: str, alias: str | None = None) -> Column:
    return F.date_format(F.col(name), "yyyy-MM-dd").alias(alias or name)


def stamp(name: str, alias: str | None = None) -> Column:
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def joined(name: str, sep: str = ",", alias: str | None = None) -> Column:
    return F.array_join(F.col(name), sep).alias(alias or name)
