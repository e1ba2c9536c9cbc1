"""Risk by when: a discrete-time hazard fitted on person-interval rows, composed over the horizons.

A person followed for so many days is one row for every whole interval they were at risk in, and the
row of the interval in which the event fell carries label 1.  Whoever is lost in the middle of an
interval was at risk only up to its beginning: censoring drops that interval, never the person.  The
per-interval hazard is either fitted by strata (events over intervals at risk, the maximum-likelihood
estimate of a constant hazard) or by a second boosted model on the risk model's features, calibrated on
the same rows and saved with a digest of its own.  Without a model every estimate says "unavailable".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.config import HORIZONS
from vigilframe.operators import evaluation as ev
from vigilframe.operators import models
from vigilframe.session import materialised

ITERATIONS = 120
PHRASE_UNAVAILABLE = "no hazard model is available"


def follow_up(people: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """people (pid, entry, left) and events (pid, on) -> pid, days at risk and whether the event ended them.

    The first event on or after entry counts; later ones, and whatever lies behind the horizon or the day
    a person left, do not.
    """
    first = events.join(people.select("pid", "entry", "left"), "pid").where(
        (F.col("on") >= F.col("entry")) & (F.col("on") <= F.col("left"))).groupBy("pid").agg(
        F.min(F.datediff("on", "entry")).alias("event_day"))
    seen = F.least(F.datediff("left", "entry"), F.lit(horizon))
    joined = people.where("entry <= left").join(first, "pid", "left")
    event = F.coalesce(F.col("event_day") < horizon, F.lit(False))
    return joined.select("pid", F.when(event, F.col("event_day")).otherwise(seen).alias("days"), event.alias("event"))


def person_intervals(followed: DataFrame, step: int) -> DataFrame:
    """Rows (..., days, event) -> one row for each interval at risk, with its number and the label.

    At most horizon / step rows a person: an explode of a short sequence, no shuffle.
    """
    last = F.floor(F.col("days") / step)
    intervals = F.when(F.col("event"), last + 1).otherwise(last).cast("int")
    rows = followed.where(intervals > 0).withColumn("interval", F.explode(F.sequence(F.lit(0), intervals - 1)))
    return rows.withColumn("label", (F.col("event") & (F.col("interval") == last)).cast("int")).drop("days", "event")


def life_table(rows: DataFrame) -> DataFrame:
    """Per interval: at risk, events, hazard and the share that is left behind it (Kaplan and Meier)."""
    table = rows.groupBy("interval").agg(F.count("*").alias("at_risk"), F.sum("label").alias("events"))
    table = table.withColumn("hazard", F.col("events") / F.col("at_risk"))
    # a row for each interval of the horizon: a handful, whatever the population
    packed = table.agg(F.array_sort(F.collect_list(F.struct("interval", "at_risk", "events", "hazard"))).alias("rows"))
    left = F.expr("aggregate(slice(rows, 1, i + 1), 1D, (s, y) -> s * (1 - y.hazard))")
    return packed.select(F.posexplode("rows").alias("i", "x"), "rows").select(
        F.col("x.interval").alias("interval"), "x.at_risk", "x.events", "x.hazard", left.alias("survival"))


def hazard_by(rows: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Constant hazard of each stratum; one without an interval at risk has no row."""
    return rows.groupBy(*strata).agg(F.count("*").alias("at_risk"), F.sum("label").alias("events")).withColumn(
        "hazard", F.col("events") / F.col("at_risk"))


def fit(rows: DataFrame, features: list[str], version: str, iterations: int = ITERATIONS) -> models.RiskModel | None:
    """The boosted hazard over person-interval rows (pid, features..., label), or None without both labels.

    A person's intervals stay on one side of the split.  Saved and loaded like the risk model, in a
    folder of its own and therefore with its own digest.  The rows are made once and written: their
    labels, their balance and the training table read what was written.
    """
    rows = materialised(rows, "hazard-rows")
    kinds = rows.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if (kinds.low, kinds.high) != (0, 1):
        return None
    return models.fit(rows, features, version, iterations=iterations)[0]


def composed(rows: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows with a ``hazard`` (null: unavailable) -> risk by horizon, median, soonest, phrase, status."""
    known = F.col("hazard").isNotNull()
    out = ev.hazard_horizons(rows, "hazard", horizons)
    made = [f"risk_{d}d" for d in horizons] + ["median_days", "soonest"]
    return out.withColumns({
        **{c: F.when(known, F.col(c)) for c in made},
        "phrase": F.when(known, F.col("phrase")).otherwise(PHRASE_UNAVAILABLE),
        "horizon_status": F.when(known, "ok").otherwise("unavailable")})


def estimate(model: models.RiskModel | None, rows: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Feature rows -> the same rows with hazard, its horizons, status and model version."""
    scored = models.score(model, rows)
    hazard = F.when(F.col("risk_status") == "ok", F.col("risk_score"))
    return composed(scored.withColumn("hazard", hazard), horizons).drop("risk_score", "risk_status")
