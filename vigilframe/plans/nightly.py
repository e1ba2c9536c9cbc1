"""The nightly run as one lazy plan, from signals to verdicts."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.operators import cases as case_ops
from vigilframe.operators import deviation, features
from vigilframe.operators.verdicts import decide
from vigilframe.session import materialised


@dataclass
class StageLog:
    """Rows and seconds per written stage, counted while the stage is written."""

    rows: list[tuple] = field(default_factory=list)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        seen, started = Observation(name), time.perf_counter()
        out = materialised(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        before = self.rows[-1][3] if self.rows else 0
        self.rows.append((name, "ok", before, int(seen.get["rows"]),
                          round(time.perf_counter() - started, 3), ""))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.rows, "name STRING, status STRING, rows_in BIGINT, rows_out BIGINT, "
                       "seconds DOUBLE, detail STRING")


@dataclass(frozen=True)
class Night:
    """The tables of one run; profile and deviations are written tables when kept."""

    daily: DataFrame
    profile: DataFrame
    deviations: DataFrame
    fractions: DataFrame
    cases: DataFrame
    verdicts: DataFrame
    consent: DataFrame


def screen(signals: DataFrame, as_of: date, cfg: Config,
           consent: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``signals`` are raw rows, or parts of days (``daily_store.history``), told by their columns."""
    if "total" in signals.columns:
        daily = features.daily_from_parts(
            signals.filter(features.age_in(F.col("day"), as_of, cfg.history_days)), consent)
    else:
        daily = features.daily_series(features.in_history(signals, as_of, cfg.history_days), consent)
    return daily, features.profiles(daily, as_of, cfg)


def nightly(signals: DataFrame, consent: DataFrame, as_of: date, cfg: Config, *,
            shortfall: DataFrame | None = None, calendar: DataFrame | None = None,
            capacity: DataFrame | None = None, risk: DataFrame | None = None,
            active: DataFrame | None = None, suppressed: DataFrame | None = None,
            frozen: Column | bool = False, keep: bool = True,
            detail: bool = True, log: StageLog | None = None) -> Night:
    """Protect, collapse, screen, assemble and decide.

    ``keep=True`` writes the profile and the deviations to the shared checkpoint folder, because
    each feeds several branches (unit baseline, cohort, fractions, cases): the raw rows are scanned
    and shuffled once.  ``keep=False`` leaves one lazy plan.
    """
    if log is not None:
        table = log.write
    else:
        table = materialised if keep else (lambda df, name: df)
    daily, profile = screen(signals, as_of, cfg, consent)
    profile = table(profile, "profile")
    devs = table(deviation.deviations(profile, cfg, shortfall), "deviations")
    fractions = deviation.unit_fractions(devs, profile)
    context = case_ops.with_unit_context(devs, fractions, calendar)
    cases = case_ops.build_cases(context, consent, capacity=capacity, risk=risk, active=active,
                                 suppressed=suppressed)
    return Night(daily, profile, devs, fractions, cases, decide(cases, cfg, frozen, detail),
                 consent)


def last_year(signals: DataFrame, consent: DataFrame, as_of: date, cfg: Config) -> DataFrame:
    """Deviations in the same window one year earlier."""
    _, profile = screen(signals, as_of.replace(year=as_of.year - 1), cfg, consent)
    return deviation.deviations(profile, cfg)


def all_cases(night: Night) -> DataFrame:
    """Every screened person: decided, or CLEARED when nothing deviated."""
    quiet = deviation.cleared(night.profile, night.deviations)
    return night.verdicts.select("pid", "unit_id", "decision", "reason", "composite", "named",
                                 "consented").unionByName(
        quiet.select("pid", "unit_id", "decision", F.lit("").alias("reason"),
                     F.lit(0.0).alias("composite"), F.lit(False).alias("named"),
                     F.lit(None).alias("consented")), allowMissingColumns=True)
