"""Shape of an on/off roster: runs, breaks and how predictable they are."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.scalar import fixed, percent
from vigilframe.operators.features import age_in

ON_LEVEL = 0.5
ADEQUATE_BREAK = 2


def runs(daily: DataFrame, as_of: date, days: int, domain: str) -> DataFrame:
    """Lengths of consecutive equal flags, over observations in day order."""
    seen = daily.filter((F.col("domain") == domain) & age_in(F.col("day"), as_of, days)).select(
        "pid", "day", (F.round("value", 9) >= ON_LEVEL).alias("on"))
    by_day = Window.partitionBy("pid").orderBy("day")
    by_flag = Window.partitionBy("pid", "on").orderBy("day")
    island = F.row_number().over(by_day) - F.row_number().over(by_flag)
    return seen.withColumn("island", island).groupBy("pid", "on", "island").agg(
        F.count("*").alias("length"))


def rhythm(daily: DataFrame, as_of: date, cfg: Config, domain: str) -> DataFrame:
    on, off = F.col("on"), ~F.col("on")
    stats = runs(daily, as_of, cfg.rhythm_days, domain).groupBy("pid").agg(
        F.sum("length").alias("observed_days"),
        F.coalesce(F.max(F.when(on, F.col("length"))), F.lit(0)).alias("longest"),
        F.count_if(on).alias("n_on"), F.count_if(off).alias("n_off"),
        F.count_if(off & (F.col("length") >= ADEQUATE_BREAK)).alias("n_rest"),
        F.avg(F.when(on, F.col("length"))).alias("mean_on"),
        F.stddev_pop(F.when(on, F.col("length"))).alias("sd_on"))
    scored = (F.col("observed_days") >= 2 * ADEQUATE_BREAK) & (F.col("n_on") > 0)
    adequacy = F.when(F.col("n_off") > 0, F.col("n_rest") / F.col("n_off")).otherwise(0.0)
    spread = (F.when(F.col("n_on") > 1, F.least(F.lit(1.0), F.col("sd_on") / F.col("mean_on")))
              .when(F.col("n_on") == 1, 1.0).otherwise(0.0))
    sustainable = F.when(F.col("longest") <= cfg.sustainable_run, 1.0).otherwise(
        cfg.sustainable_run / F.col("longest"))

    def when_scored(value: Column) -> Column:
        return F.when(scored, F.round(value, 4)).otherwise(0.0)

    out = stats.select(
        "pid", "observed_days",
        F.when(scored, F.col("longest")).otherwise(0).cast("bigint").alias("longest_run"),
        when_scored(adequacy).alias("break_adequacy"),
        when_scored(spread).alias("block_variance"),
        when_scored((1.0 - spread) * (0.5 + 0.5 * adequacy) * sustainable).alias("regularity"))
    return out.withColumn("phrase", phrase(cfg))


def phrase(cfg: Config) -> Column:
    longest = F.col("longest_run")
    return F.when(longest == 0, F.concat(
        F.lit("no duty days recorded in the last "), F.col("observed_days").cast("string"),
        F.lit(" days"))).otherwise(F.concat(
            F.lit("longest unbroken run "), longest.cast("string"), F.lit(" days"),
            F.when(longest > cfg.sustainable_run,
                   F.lit(f" — beyond the {cfg.sustainable_run}-day sustainable run"))
            .otherwise(""), F.lit("; "), percent(F.col("break_adequacy")),
            F.lit(f" of breaks were {ADEQUATE_BREAK} days or longer; roster regularity "),
            fixed(F.col("regularity"), 2)))
