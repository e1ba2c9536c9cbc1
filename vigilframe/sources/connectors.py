"""Records sources by domain: who delivers a domain's rows, how they are read, and what is refused.

A connector turns what one system exports into canonical text rows (service_no, unit, date, value,
timestamp, domain).  Extracts lie in a folder for each day they were loaded (``loaded=2024-01-30``).  A
record is loaded on its day or later, so the folders before a period cannot hold rows of it: the bound
is a filter on the folder name, and the scan does not open them.  Late rows lie in later folders and are
read.  A registry names one connector per domain; a run asks it for its domains, validates all rows in
one pass, hands the good ones on and writes the refused ones, as they came and with the reason, to a
quarantine that a repeated run replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.operators.protect import accepted, source_status, validate
from vigilframe.session import materialised
from vigilframe.sources.delimited import CANONICAL, empty, exists

LOADED = "loaded"
#: session domains come from a sitting, never from a records system
SESSION_DOMAINS = ("voice",)
#: (spark, first day) -> canonical rows, or None when the source is not there
Reader = Callable[[SparkSession, date], DataFrame | None]


@dataclass(frozen=True)
class DelimitedFolder:
    """Delimited files in a folder for each loaded day; ``columns`` maps canonical to source names."""

    domain: str
    path: str
    delimiter: str = ","
    columns: Mapping[str, str] = field(default_factory=dict)

    def __call__(self, spark: SparkSession, first: date) -> DataFrame | None:
        if not exists(spark, self.path):
            return None
        rows = (spark.read.option("header", True).option("sep", self.delimiter).option("mode", "PERMISSIVE")
                .option("inferSchema", False).option("basePath", self.path).csv(self.path))
        rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
        if LOADED in rows.columns:
            rows = rows.where(F.col(LOADED) >= F.lit(first).cast(rows.schema[LOADED].dataType))
        return self.canonical(rows)

    def canonical(self, rows: DataFrame) -> DataFrame:
        """Every canonical name, as text; only the timestamp may be missing."""
        named = {name: self.columns.get(name, name) for name in CANONICAL}
        missing = [c for name, c in named.items() if c not in rows.columns and name != "timestamp"]
        if missing:
            raise ValueError(f"{self.path}: columns {missing} are missing")
        return rows.select(*[
            (F.col(f"`{c}`") if c in rows.columns else F.lit(None)).cast("string").alias(name)
            for name, c in named.items()], F.lit(self.domain).alias("domain"))


class Registry:
    """One connector per domain."""

    def __init__(self, *connectors: DelimitedFolder):
        self.readers: dict[str, Reader] = {}
        self.rates: dict[str, float] = {}
        for connector in connectors:
            self.register(connector.domain, connector)

    def register(self, domain: str, reader: Reader, rows_per_person_day: float = 1.0) -> None:
        if domain in SESSION_DOMAINS:
            raise ValueError(f"{domain} comes from a sitting, never from a records source")
        if domain in self.readers:
            raise ValueError(f"{domain} has a connector already")
        self.readers[domain], self.rates[domain] = reader, rows_per_person_day


@dataclass(frozen=True)
class Pulled:
    """What a run starts from."""

    signals: DataFrame
    refused: DataFrame
    status: DataFrame


def pull(spark: SparkSession, registry: Registry, cfg: Config, as_of: date, days: int, roster_size: int,
         quarantine: str | None = None) -> Pulled:
    """All registered sources of one period.

    A source that is not there contributes no rows and the status ``unavailable``.  The checked rows are
    written once: good rows, refused rows and counts are three reads of it.
    """
    if not registry.readers:
        raise ValueError("no source is registered")
    first = as_of - timedelta(days=days - 1)
    rows, expected = [], []
    for domain, reader in registry.readers.items():
        cfg.scale_of(domain)
        found = reader(spark, first)
        rows.append(empty(spark, domain) if found is None else found)
        expected.append((domain, round(roster_size * days * registry.rates[domain]), found is not None))
    checked = materialised(validate(reduce(DataFrame.unionByName, rows), cfg, as_of, days), "checked")
    refused = checked.where("reject_reason is not null").select("domain", *CANONICAL, "reject_reason")
    if quarantine is not None:
        refused.write.mode("overwrite").partitionBy("domain").parquet(f"{quarantine}/as_of={as_of.isoformat()}")
    table = spark.createDataFrame(expected, "domain STRING, expected_rows BIGINT, available BOOLEAN")
    return Pulled(accepted(checked), refused, source_status(checked, table))


def write_extract(rows: DataFrame, connector: DelimitedFolder) -> None:
    """Canonical rows with ``loaded`` -> the files that the connector reads."""
    out = rows.select(*[F.col(c).alias(connector.columns.get(c, c)) for c in CANONICAL], LOADED)
    (out.repartition(LOADED).write.mode("overwrite").option("header", True).option("sep", connector.delimiter)
     .partitionBy(LOADED).csv(connector.path))
