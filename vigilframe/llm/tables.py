"""Reading the corpus tables and writing the intermediate ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: the six characters every contract here counts as white space
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session (a test) may lack one."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that every executor reaches")
    named = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set(CHECKPOINT_DIR, named)
    return named


class Scratch:
    """Tables that one call writes below the shared folder.

    A written table cuts the lineage: losing an executor later costs a read of the table.  ``drop``
    removes what no later step reads; ``clear`` the rest, once the call's result has been used.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._remove(f"{self.folder}/{name}")

    def clear(self) -> None:
        self._remove(self.folder)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; a text of one byte per character takes the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n: the fold a row belongs to."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
