"""Daily series, trailing windows, personal and unit baselines.

Raw rows are pre-aggregated map-side per (pid, domain, day, unit) before the first shuffle, so a
person who holds a third of all raw rows still spreads over every task.  After that a person has at
most ``domains x history`` rows, and one exchange on ``pid`` serves every later step: the windows,
the per-domain aggregate and the case row all reuse that partitioning.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.scalar import settled
from vigilframe.operators.protect import consent_filter

KEY = ("pid", "domain")


def in_history(signals: DataFrame, as_of: date, days: int) -> DataFrame:
    """Keep ``as_of - days + 1 .. as_of``.

    The bounds are constants of the column's own type, so they reach the scan as pushed filters (and
    prune partitions where the column is one).
    """
    kind = signals.schema["observed_at"].dataType.simpleString()
    first = F.lit(as_of - timedelta(days=days - 1)).cast(kind)
    after = F.lit(as_of + timedelta(days=1)).cast(kind)
    return signals.filter((F.col("observed_at") >= first) & (F.col("observed_at") < after))


def age_in(day: Column, as_of: date, days: int, lag: int = 0) -> Column:
    age = F.datediff(F.lit(as_of), day)
    return (age >= lag) & (age < lag + days)


def daily_parts(signals: DataFrame) -> DataFrame:
    """First, skew-proof half of the daily collapse: sums that can be merged later."""
    return (
        signals.select("pid", "domain", F.to_date("observed_at").alias("day"), "unit_id",
                       "value", "observed_at")
        .groupBy("pid", "domain", "day", "unit_id")
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"),
             F.max("observed_at").alias("seen"))
    )


def daily_series(signals: DataFrame, consent: DataFrame | None = None) -> DataFrame:
    """One value per (pid, domain, day), with the unit the person was last seen in.

    Consent reads only the person and the domain, so it is applied to the pre-aggregated rows: the
    join then reuses the exchange on ``pid`` and the raw rows are never shuffled for it.
    """
    return daily_from_parts(daily_parts(signals), consent)


def daily_from_parts(parts: DataFrame, consent: DataFrame | None = None) -> DataFrame:
    """Second half: parts of raw rows or of the daily store, merged per person."""
    parts = parts.repartition("pid")
    if consent is not None:
        parts = consent_filter(parts, consent)
    last_seen = F.max(F.struct("seen", "unit_id")).over(Window.partitionBy("pid"))
    return (
        parts.withColumn("unit_id", last_seen["unit_id"])
        .groupBy("pid", "unit_id", "domain", "day")
        .agg((F.sum("total") / F.sum("n")).alias("value"), F.sum("n").alias("rows"))
    )


def window_stats(daily: DataFrame, as_of: date, days: int, lag: int, cfg: Config) -> DataFrame:
    """Count, mean, floored population deviation and latest value of one (lagged) window."""
    inside = daily.filter(age_in(F.col("day"), as_of, days, lag))
    stats = inside.groupBy(*KEY).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.greatest(F.stddev_pop("value"), F.lit(cfg.min_stdev)).alias("stdev"),
        F.max_by("value", "day").alias("latest"),
    )
    return stats.withColumn("usable", F.col("n") >= cfg.min_observations)


def profiles(daily: DataFrame, as_of: date, cfg: Config) -> DataFrame:
    """Everything a deviation needs for one (pid, domain), in one pass over the daily rows.

    The breach level depends on the person's own lagged baseline.  It is attached by a window over
    the same keys instead of a second scan joined to the baseline.
    """
    age = F.datediff(F.lit(as_of), F.col("day"))
    rows = daily.withColumn("age", age).filter((age >= 0) & (age < cfg.history_days))
    lagged = F.when((F.col("age") >= cfg.baseline_lag)
                    & (F.col("age") < cfg.baseline_lag + cfg.baseline_days), F.col("value"))
    person = Window.partitionBy(*KEY)
    rows = rows.select(
        "*", F.count(lagged).over(person).alias("base_n"),
        F.avg(lagged).over(person).alias("base_mean"),
        F.stddev_pop(lagged).over(person).alias("base_stdev"),
    ).withColumns({
        "base_mean": F.coalesce("base_mean", F.lit(0.0)),
        "base_stdev": F.greatest(F.coalesce("base_stdev", F.lit(0.0)), F.lit(cfg.min_stdev)),
    })
    rows = rows.withColumn("level", F.col("base_mean") + cfg.breach_z * F.col("base_stdev"))
    over = F.round("value", 9) >= F.round("level", 9)
    aggs = [
        F.max("base_n").alias("base_n"),
        F.max("base_mean").alias("base_mean"),
        F.max("base_stdev").alias("base_stdev"),
        F.max("level").alias("level"),
        F.max_by("value", "day").alias("latest"),
    ]
    for days in sorted(set(cfg.feature_windows) | set(cfg.persistence_windows)):
        inside = F.col("age") < days
        aggs.append(F.count_if(inside).alias(f"n_{days}"))
        aggs.append(F.avg(F.when(inside, F.col("value"))).alias(f"mean_{days}"))
    for i, days in enumerate(cfg.persistence_windows):
        aggs.append((F.count_if((F.col("age") < days) & over) / F.lit(days)).alias(f"breach_{i}"))
    out = rows.groupBy("pid", "unit_id", "domain").agg(*aggs)
    # one marked row per person: people are counted later without another distinct
    first = F.row_number().over(Window.partitionBy("pid").orderBy("domain")) == 1
    return out.withColumn("is_first", first)


def unit_baseline(profile: DataFrame, cfg: Config, days: int | None = None) -> DataFrame:
    """Spread of per-person window means in a unit: people count once, however many rows."""
    days = days or min(cfg.feature_windows)
    return (
        profile.filter(F.col(f"n_{days}") > 0)
        .groupBy("unit_id", "domain")
        .agg(F.count("*").alias("unit_n"),
             F.avg(f"mean_{days}").alias("unit_mean"),
             F.greatest(F.stddev_pop(f"mean_{days}"), F.lit(cfg.min_stdev)).alias("unit_stdev"))
    )


def people(profile: DataFrame) -> DataFrame:
    """One row per screened person."""
    return profile.filter("is_first").select("pid", "unit_id")


def cohort_sizes(profile: DataFrame) -> DataFrame:
    return people(profile).groupBy("unit_id").agg(F.count("*").alias("cohort_size"))


def membership(daily: DataFrame) -> DataFrame:
    """Latest unit and the domains seen, per person.  The domain set is bounded by the config."""
    seen = daily.groupBy("pid", "unit_id", "domain").agg(F.count("*").alias("days"))
    return seen.groupBy("pid", "unit_id").agg(
        F.array_sort(F.collect_list("domain")).alias("domains"),
        F.sum("days").alias("observed_days"))


def feature_matrix(profile: DataFrame, cfg: Config) -> DataFrame:
    """Window means per domain plus a short-minus-long slope; absent series read as 0 here."""
    windows = cfg.feature_windows
    aggs = []
    for domain in cfg.domains:
        means = {
            w: F.coalesce(F.max(F.when(F.col("domain") == domain, F.col(f"mean_{w}"))), F.lit(0.0))
            for w in windows
        }
        aggs += [settled(means[w], 6).alias(f"{domain}_mean_{w}d") for w in windows]
        aggs.append(settled(means[min(windows)] - means[max(windows)], 6).alias(f"{domain}_slope"))
    return profile.groupBy("pid", "unit_id").agg(*aggs)


def feature_names(cfg: Config) -> list[str]:
    return [f"{d}_mean_{w}d" for d in cfg.domains for w in cfg.feature_windows] + [
        f"{d}_slope" for d in cfg.domains]


def retained(daily: DataFrame, as_of: date, cfg: Config) -> DataFrame:
    """Rows inside the retention period; rewrite the date partitions with the result."""
    return daily.filter(F.col("day") >= F.date_sub(F.lit(as_of), cfg.retention_days))


def rolling_stats(daily: DataFrame, days: int, lag: int) -> DataFrame:
    """The same lagged window for every day of history, for backfills."""
    frame = (Window.partitionBy(*KEY).orderBy("day_no").rangeBetween(-(lag + days - 1), -lag))
    return (
        daily.withColumn("day_no", F.datediff("day", F.lit(date(1970, 1, 1))))
        .select(*KEY, "day",
                F.count("value").over(frame).alias("n"),
                F.avg("value").over(frame).alias("mean"))
    )
