"""Federated averaging of parameter vectors under a privacy budget."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.scalar import keyed_uniform, total
from vigilframe.session import materialised


def l2(vector: Column) -> Column:
    return F.sqrt(total(vector, lambda x: x * x))


def clipped(vector: Column, norm: Column, limit: float) -> Column:
    """Scale down to the limit; a small update is never scaled up."""
    return F.when(norm <= limit, vector).otherwise(
        F.transform(vector, lambda x: x * (limit / norm)))


def unit_deltas(local: DataFrame, base: DataFrame | None, cfg: Config) -> DataFrame:
    """local: (unit_id, parameters, n_examples) -> delta against the global vector, clipped.

    ``base`` has one row (parameters); it is read as a scalar, not joined.
    """
    delta = F.col("parameters")
    if base is not None:
        current = base.select("parameters").scalar()
        delta = F.zip_with(F.col("parameters"), current, lambda a, b: a - b)
    out = local.withColumn("delta", delta)
    out = out.withColumn("norm", l2(F.col("delta")))
    return out.select("unit_id", "n_examples", "norm", (F.col("norm") > cfg.clip_norm).alias("clipped"),
                      clipped(F.col("delta"), F.col("norm"), cfg.clip_norm).alias("update"))


def with_noise(deltas: DataFrame, secret: str, round_id: int, cfg: Config) -> DataFrame:
    """Gaussian noise per coordinate, after the clip and before anything leaves the unit.

    The draws come from a keyed hash (Box-Muller), so a retried task sends the same update.
    """
    rows = deltas.select("unit_id", "n_examples", "clipped", F.posexplode("update"))
    return rows.select("unit_id", "n_examples", "clipped", "pos",
                       (F.col("col") + unit_noise(secret, round_id, cfg)).alias("col"))


def unit_noise(secret: str, round_id: int, cfg: Config) -> Column:
    key = (F.lit(round_id), F.col("unit_id"), F.col("pos"))
    u1 = keyed_uniform(secret, *key, F.lit("r"))
    u2 = keyed_uniform(secret, *key, F.lit("a"))
    return cfg.noise_multiplier * cfg.clip_norm * F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)


def coordinates(deltas: DataFrame) -> DataFrame:
    return deltas.select("unit_id", "n_examples", "clipped", F.posexplode("update"))


def average(coordinate_rows: DataFrame) -> DataFrame:
    """Example-weighted mean per coordinate."""
    return coordinate_rows.groupBy("pos").agg(
        (F.sum(F.col("col") * F.col("n_examples")) / F.sum("n_examples")).alias("step"))


def rounds(updates: DataFrame, cfg: Config) -> DataFrame:
    """updates: (campaign, round, unit_id) -> which rounds ran, which were skipped, and why.

    A round spends its epsilon only when enough units reported, so the running sum is over the
    rounds of one campaign, a short list bounded by the campaign's own schedule.
    """
    per = updates.groupBy("campaign", "round").agg(F.count_distinct("unit_id").alias("units"))
    enough = F.col("units") >= cfg.min_participants
    order = Window.partitionBy("campaign").orderBy("round").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    asked = F.sum(F.when(enough, cfg.fed_epsilon_round).otherwise(0.0)).over(order)
    out = per.withColumn("asked", asked)
    completed = enough & (F.round("asked", 9) <= cfg.fed_epsilon_total)
    return out.select(
        "campaign", "round", "units", completed.alias("completed"),
        F.when(completed, cfg.fed_epsilon_round).otherwise(0.0).alias("epsilon"),
        F.when(~enough, "too few units").when(~completed, "budget exhausted").otherwise("")
        .alias("reason"))


def campaign_report(played: DataFrame, cfg: Config) -> DataFrame:
    spent = F.sum("epsilon")
    return played.groupBy("campaign").agg(
        F.count_if("completed").alias("rounds_completed"),
        F.count_if(~F.col("completed")).alias("rounds_skipped"),
        F.round(spent, 4).alias("epsilon_spent"),
        F.round(F.greatest(F.lit(0.0), cfg.fed_epsilon_total - spent), 4).alias("epsilon_remaining"))


@dataclass(frozen=True)
class Played:
    """A campaign round by round: the global vector after each, and what each did."""

    vectors: list[DataFrame]
    history: list[tuple]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.history, "campaign STRING, round BIGINT, units BIGINT, participants ARRAY<STRING>, completed BOOLEAN, "
                          "epsilon DOUBLE, spent DOUBLE, clipped BIGINT, reason STRING")


def play(campaign: str, base: DataFrame, reports: Sequence[DataFrame], cfg: Config, *, secret: str | None = None,
         spent: float = 0.0) -> Played:
    """Play the rounds of one campaign, each against the global vector the one before left.

    base: (pos, value); reports: per round (unit_id, pos, value, n_examples) of who reported.  A round with
    too few units, or one the budget no longer covers, is skipped: it spends nothing and leaves the vector.
    The schedule is a short list; within a round everything is grouped by unit and by coordinate, and the
    new vector is written, so a later round reads a table and not the rounds before it.  ``spent`` is what
    earlier campaigns used of the same budget; with ``secret`` every unit adds its noise.
    """
    spark, vectors, history = base.sparkSession, [], []
    for number, told in enumerate(reports, 1):
        told = materialised(told, f"reports-{number}")
        names = sorted(r.unit_id for r in told.select("unit_id").distinct().collect())
        enough = len(names) >= cfg.min_participants
        covered = round(spent + cfg.fed_epsilon_round, 9) <= cfg.fed_epsilon_total
        reason = "" if enough and covered else "too few units" if not enough else "budget exhausted"
        clipped_units = 0
        if not reason:
            moved = told.join(base.withColumnRenamed("value", "was"), "pos").select(
                "unit_id", "pos", "n_examples", (F.col("value") - F.col("was")).alias("delta"))
            norms = moved.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("norm"))
            norms = materialised(norms, f"norms-{number}")
            clipped_units = norms.where(F.col("norm") > cfg.clip_norm).count()
            update = F.col("delta") * F.when(F.col("norm") > cfg.clip_norm, cfg.clip_norm / F.col("norm")).otherwise(1.0)
            rows = moved.join(norms, "unit_id").withColumn("col", update)
            if secret is not None:
                rows = rows.withColumn("col", F.col("col") + unit_noise(secret, number, cfg))
            base = materialised(base.join(average(rows), "pos", "left").select(
                "pos", (F.col("value") + F.coalesce("step", F.lit(0.0))).alias("value")), f"global-{number}")
            spent += cfg.fed_epsilon_round
        vectors.append(base)
        history.append((campaign, number, len(names), names, not reason, 0.0 if reason else cfg.fed_epsilon_round,
                        round(spent, 9), clipped_units, reason))
    return Played(vectors, history)
