"""Exports and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.scalar import settled
from vigilframe.operators.features import feature_names
from vigilframe.operators.protect import latest_by

SAMPLE_ROWS = 5000
POSITIVE_SCORE = 0.55


def recent_sample(signals: DataFrame, unit_id: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The latest rows of one unit; the limit is the export and plans as a distributed top-k."""
    return (signals.filter(F.col("unit_id") == unit_id)
            .orderBy(F.col("observed_at").desc(), "pid", "domain", "value").limit(rows))


def labelled_roster(people: DataFrame, units: DataFrame) -> DataFrame:
    """people: (pid, unit_id, score, ...) with the unit's columns and the label derived from score."""
    return people.join(units, "unit_id").withColumn(
        "label_positive", (F.col("score") >= POSITIVE_SCORE).cast("int"))


def training_matrix(matrix: DataFrame, groups: DataFrame, cfg: Config) -> DataFrame:
    names = feature_names(cfg)
    keys = sorted(c for c in groups.columns if c not in ("pid", "label"))
    return matrix.join(groups, "pid").select(
        *[settled(F.col(n), 6).alias(n) for n in names], *keys, "label")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").text(path)


def merged_snapshot(current: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Upsert: the last write per key over the old snapshot and the new rows."""
    return latest_by(current.unionByName(changes), key, seq)
