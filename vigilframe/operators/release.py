"""Aggregates that leave the system: k-anonymous cells, noise, budget and the release memory."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import GATES, Config
from vigilframe.functions.scalar import keyed_uniform, laplace, settled

SUPPRESSED_BAND = "suppressed"
BANDS = ((0.75, "critical"), (0.55, "high"), (0.35, "moderate"), (0.18, "low"))
CELL_CHARGES = 2  # a count and a mean


# ----------------------------------------------------------------------- distributions ---
def unit_series(cases: DataFrame) -> DataFrame:
    """cases with gate values (NULL when cleared) -> (unit_id, label, value), one row per number.

    A bounded unpivot of each row: no per-person structure leaves this function aggregated.
    """
    entries = [F.struct(F.lit("fatigue index").alias("label"), F.col("composite").alias("value"))]
    entries += [F.struct(F.lit(f"{g} gate").alias("label"), F.col(g).alias("value")) for g in GATES]
    entries += [
        F.struct(F.lit("deviating share").alias("label"),
                 (F.col("decision") != "CLEARED").cast("double").alias("value")),
        F.struct(F.lit("under active monitoring").alias("label"),
                 (F.col("decision") == "MONITOR").cast("double").alias("value"))]
    return cases.select("unit_id", F.inline(F.array(*entries))).filter("value IS NOT NULL")


def heat_series(cases: DataFrame, sub_unit: Column, cfg: Config) -> DataFrame:
    """(unit, sub-unit, domain) values; a domain the case did not see counts as an empty square."""
    seen = F.transform("consented", lambda d: d["domain"])
    squares = F.array(*[F.struct(
        F.lit(d).alias("domain"),
        F.when(F.array_contains(seen, d), F.col("composite")).alias("value"))
        for d in cfg.heat_domains])
    return cases.select("unit_id", sub_unit.alias("sub_unit"), F.inline(squares))


def hashed_sub_unit(sub_units: int = 4) -> Column:
    return company(F.pmod(F.xxhash64("pid"), F.lit(sub_units)))


def company(index: Column) -> Column:
    return F.concat(F.lit("Coy "), F.char(F.lit(65) + index))


# ------------------------------------------------------------------------------- cells ---
def cells(values: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """k-checked cells, before any noise.  A cell below k keeps neither its count nor its value."""
    grouped = values.groupBy(*keys).agg(F.count("value").alias("true_n"),
                                        F.avg("value").alias("true_mean"))
    small = F.col("true_n") < cfg.k_min
    return grouped.withColumns({
        "suppressed": small,
        "reason": F.when(small, f"cohort below k={cfg.k_min}").otherwise(""),
    })


def exact(checked: DataFrame) -> DataFrame:
    """Release without noise, for deployments that switch it off."""
    visible = ~F.col("suppressed")
    return checked.withColumns({
        "n": F.when(visible, F.col("true_n")).otherwise(0),
        "value": F.when(visible, settled(F.col("true_mean"), 4)),
    }).drop("true_n", "true_mean")


def noised(checked: DataFrame, keys: list[str], as_of: date, secret: str, cfg: Config) -> DataFrame:
    """Laplace noise from a keyed hash of the question, so asking again gives the same answer."""
    question = [F.lit(as_of.isoformat()), *[F.col(k) for k in keys]]
    scale = F.lit(1.0 / cfg.epsilon_query)
    count = F.rint(F.col("true_n") + laplace(
        scale, keyed_uniform(secret, *question, F.lit("n")))).cast("bigint")
    mean = F.col("true_mean") + laplace(
        scale / F.col("true_n"), keyed_uniform(secret, *question, F.lit("mean")))
    visible = ~F.col("suppressed")
    return checked.withColumns({
        "n": F.when(visible, F.greatest(count, F.lit(cfg.k_min))).otherwise(0),
        "value": F.when(visible, settled(mean, 4)),
    }).drop("true_n", "true_mean")


def within_budget(checked: DataFrame, period: list[str], label: str, cfg: Config,
                  earlier: DataFrame | None = None) -> DataFrame:
    """Stop releasing once the period's budget is gone; a cell is charged for count and mean at once.

    Cells of one period are a fixed list of labels, so the running sum is short.  ``earlier`` (the period's
    columns and ``earlier``, see ``charged``) is what releases before this one spent of the same budget.
    """
    order = Window.partitionBy(*period).orderBy(label).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cost = F.when(F.col("suppressed"), 0.0).otherwise(CELL_CHARGES * cfg.epsilon_query)
    if earlier is None:
        out = checked.withColumn("spent", F.sum(cost).over(order))
    else:
        out = checked.join(earlier.select(*period, "earlier"), period, "left").withColumn(
            "spent", F.sum(cost).over(order) + F.coalesce("earlier", F.lit(0.0))).drop("earlier")
    return out.filter(F.round("spent", 9) <= cfg.epsilon_total)


def charged(released: DataFrame, period: list[str]) -> DataFrame:
    """What a release within its budget has spent of each period, for the release after it."""
    return released.groupBy(*period).agg(F.max("spent").alias("earlier"))


def redacted(released: DataFrame) -> DataFrame:
    visible = ~F.col("suppressed")
    return released.withColumns({"n": F.when(visible, F.col("n")),
                                 "value": F.when(visible, F.col("value"))})


def band(value: Column, suppressed: Column) -> Column:
    out = F.when(suppressed | value.isNull(), SUPPRESSED_BAND)
    for floor, name in BANDS:
        out = out.when(value >= floor, name)
    return out.otherwise("nominal")


def release_log(released: DataFrame, unit: str, cfg: Config) -> DataFrame:
    return released.groupBy(unit).agg(
        F.count("*").alias("cells"), F.count_if("suppressed").alias("suppressed"),
        (F.count_if(~F.col("suppressed")) * CELL_CHARGES * cfg.epsilon_query).alias("epsilon")
    ).withColumn("action", F.when(F.col("suppressed") < F.col("cells"), "aggregate.released")
                 .otherwise("aggregate.suppressed"))


# ------------------------------------------------------------------- budget and memory ---
def admitted(charges: DataFrame, period: str, seq: str, cfg: Config) -> DataFrame:
    """The charges a period's budget still covers, in order of arrival.

    Every charge costs the same, so a period admits its first total / epsilon charges; keeping the
    first k of a group is limited before the shuffle, however many charges one period received.
    """
    room = int(round(cfg.epsilon_total / cfg.epsilon_query, 9))
    w = Window.partitionBy(period).orderBy(seq)
    return charges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= room)


def budget_report(charges: DataFrame, period: str, cfg: Config) -> DataFrame:
    room = int(round(cfg.epsilon_total / cfg.epsilon_query, 9))
    asked = charges.groupBy(period).agg(F.count("*").alias("asked"))
    taken = F.least(F.col("asked"), F.lit(room))
    return asked.select(
        period, "asked", taken.alias("admitted"), (F.col("asked") - taken).alias("refused"),
        (taken * cfg.epsilon_query).alias("spent"),
        (cfg.epsilon_total - taken * cfg.epsilon_query).alias("remaining"))


def cache_use(questions: DataFrame, released: DataFrame, keys: list[str]) -> DataFrame:
    """Hits and misses per question: only the first asking of an unreleased one is a miss."""
    asked = questions.groupBy(*keys).agg(F.count("*").alias("asked"))
    known = released.select(*keys).distinct().withColumn("known", F.lit(1))
    out = asked.join(known, keys, "left")
    misses = F.when(F.col("known").isNull(), 1).otherwise(0).cast("bigint")
    return out.select(*keys, (F.col("asked") - misses).alias("hits"), misses.alias("misses"))


def new_questions(questions: DataFrame, released: DataFrame, keys: list[str]) -> DataFrame:
    return questions.select(*keys).distinct().join(released.select(*keys), keys, "left_anti")
