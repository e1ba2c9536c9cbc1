"""Delimited extracts: one source per domain, everything read as text and typed later."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.operators.protect import accepted, source_status, validate

CANONICAL = ("service_no", "unit", "date", "value", "timestamp")


@dataclass(frozen=True)
class Extract:
    """Where a domain's rows come from and what its columns are called there."""

    domain: str
    path: str
    delimiter: str = ","
    columns: Mapping[str, str] = field(default_factory=dict)
    rows_per_person_day: float = 1.0


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system the path names, before a plan is built on it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) is not None \
        and len(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)) > 0


def empty(spark: SparkSession, domain: str) -> DataFrame:
    schema = ", ".join(f"{c} STRING" for c in CANONICAL)
    return spark.createDataFrame([], schema).withColumn("domain", F.lit(domain))


def scan(spark: SparkSession, extract: Extract) -> DataFrame:
    """All columns as text, renamed to canonical names; a missing optional column is NULL.

    The header is taken from the file, so column order does not matter.  A byte-order mark is
    stripped from the first name.
    """
    rows = (spark.read.option("header", True).option("sep", extract.delimiter)
            .option("inferSchema", False).option("mode", "PERMISSIVE").csv(extract.path))
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    have = set(rows.columns)
    picked = []
    for name in CANONICAL:
        source = extract.columns.get(name, name)
        if source in have:
            picked.append(F.col(f"`{source}`").cast("string").alias(name))
        elif name == "timestamp":
            picked.append(F.lit(None).cast("string").alias(name))
        else:
            raise ValueError(f"{extract.path}: column {source!r} for {name!r} is missing")
    return rows.select(*picked, F.lit(extract.domain).alias("domain"))


def pull(spark: SparkSession, extracts: list[Extract], cfg: Config, as_of: date, days: int,
         roster_size: int) -> tuple[DataFrame, DataFrame]:
    """Every source of a run: (accepted signals, one status row per domain).

    A source whose file is missing contributes no rows and an ``unavailable`` status; session
    domains may not be pulled at all.
    """
    barred = [e.domain for e in extracts if e.domain == "voice"]
    if barred:
        raise ValueError("a voice signal comes from a sitting, never from a records source")
    scans, expected = [], []
    for extract in extracts:
        cfg.scale_of(extract.domain)
        there = exists(spark, extract.path)
        scans.append(scan(spark, extract) if there else empty(spark, extract.domain))
        expected.append((extract.domain,
                         round(roster_size * days * extract.rows_per_person_day), there))
    rows = scans[0]
    for other in scans[1:]:
        rows = rows.unionByName(other)
    checked = validate(rows, cfg, as_of, days)
    table = spark.createDataFrame(
        expected, "domain STRING, expected_rows BIGINT, available BOOLEAN")
    return accepted(checked), source_status(checked, table)
