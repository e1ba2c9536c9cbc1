"""Who moved away from their own lagged baseline, or stands out from their unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.scalar import clamp, lookup, reaches, settled, z_score
from vigilframe.operators.features import cohort_sizes, people, unit_baseline


def tier_of(domain: Column, cfg: Config) -> Column:
    return lookup(cfg.domain_tier, domain)


def weight_of(domain: Column, cfg: Config) -> Column:
    return lookup({d: float(cfg.tier_weight[t]) for d, t in cfg.domain_tier.items()}, domain)


def deviations(profile: DataFrame, cfg: Config, shortfall: DataFrame | None = None) -> DataFrame:
    """One row per deviating (pid, domain).

    The unit baseline is joined without a hint: it has one row per (unit, domain), which grows with
    the number of units, so adaptive execution broadcasts it only when its measured size allows.
    """
    short = min(cfg.feature_windows)
    screenable = profile.filter((F.col("base_n") >= cfg.min_observations)
                                & (F.col(f"n_{short}") > 0))
    joined = screenable.join(unit_baseline(profile, cfg), ["unit_id", "domain"], "left")
    base_mean, base_sd = F.col("base_mean"), F.col("base_stdev")
    recent = F.col(f"mean_{short}")
    z_self = z_score(recent, base_mean, base_sd)
    z_unit = z_score(recent, F.col("unit_mean"), F.col("unit_stdev"))
    breached = sum(
        (F.when(reaches(F.abs(z_score(F.coalesce(F.col(f"mean_{d}"), F.lit(0.0)),
                                      base_mean, base_sd)), cfg.z_self), 1).otherwise(0)
         for d in cfg.persistence_windows), F.lit(0))
    scored = (
        joined.withColumn("z_self_raw", z_self).withColumn("z_unit_raw", z_unit)
        .filter(reaches(F.abs(F.col("z_self_raw")), cfg.z_self)
                | reaches(F.abs(F.col("z_unit_raw")), cfg.z_unit))
    )
    if shortfall is not None:
        # one row per configured domain, so its size is bounded by the config
        scored = scored.join(F.broadcast(shortfall.select("domain", "missing_fraction")),
                             "domain", "left")
        missing = clamp(F.coalesce(F.col("missing_fraction"), F.lit(0.0)))
    else:
        missing = F.lit(0.0)
    return scored.select(
        "pid", "unit_id", "domain",
        settled(F.col("z_self_raw"), 4).alias("z_self"),
        settled(F.col("z_unit_raw"), 4).alias("z_unit"),
        F.when(F.round("z_self_raw", 9) >= 0, "elevated").otherwise("reduced").alias("direction"),
        breached.cast("bigint").alias("windows_breached"),
        tier_of(F.col("domain"), cfg).alias("tier"),
        weight_of(F.col("domain"), cfg).alias("weight"),
        "breach_0", "breach_1", "breach_2",
        settled(missing, 4).alias("missing"),
    )


def unit_fractions(devs: DataFrame, profile: DataFrame) -> DataFrame:
    """Largest share of a unit that deviates the same way in a domain."""
    by_way = devs.groupBy("unit_id", "domain").agg(
        F.count_if(F.col("direction") == "elevated").alias("up"),
        F.count_if(F.col("direction") == "reduced").alias("down"))
    return by_way.join(cohort_sizes(profile), "unit_id").select(
        "unit_id", "domain", "cohort_size",
        (F.greatest("up", "down") / F.col("cohort_size")).alias("unit_fraction"))


def candidates(devs: DataFrame) -> DataFrame:
    return devs.select("pid", "unit_id").distinct()


def cleared(profile: DataFrame, devs: DataFrame) -> DataFrame:
    """Everyone screened for whom nothing was found."""
    quiet = people(profile).join(devs.select("pid"), "pid", "left_anti")
    return quiet.select("pid", "unit_id", F.lit("CLEARED").alias("decision"))
