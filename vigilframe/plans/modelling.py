"""Queries about scores: how they rank, calibrate, explain and federate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.config import HORIZONS
from vigilframe.operators import evaluation as ev
from vigilframe.operators import federated, features, models, survival
from vigilframe.plans.registry import Registry, joined, r9
from vigilframe.plans.screening import profile_of
from vigilframe.session import materialised
from vigilframe.sources import sinks
from vigilframe.sources import tables as T

QUERIES = Registry()
CFG = T.EVENTS_CONFIG
FED = CFG.but(clip_norm=0.05, fed_epsilon_total=8.0)


@QUERIES.query
def score_auroc(spark, folder):
    return ev.auroc(T.labelled_scores(spark, folder)).select("positives", "negatives", r9("auroc"))


@QUERIES.query
def threshold_curve(spark, folder):
    return ev.threshold_curve(T.labelled_scores(spark, folder)).select(
        r9("threshold"), "flagged", "tp", r9("precision"), r9("recall"))


@QUERIES.query
def threshold_choice(spark, folder):
    curve = ev.threshold_curve(T.labelled_scores(spark, folder))
    return ev.select_threshold(curve, CFG.target_precision).select(
        r9("threshold"), r9("precision"), r9("recall"))


@QUERIES.query
def calibration_error(spark, folder):
    return ev.calibration_error(T.labelled_scores(spark, folder))


@QUERIES.query
def subgroup_metrics(spark, folder):
    return ev.subgroup_metrics(T.labelled_scores(spark, folder), ["lang", "source"], 0.5)


@QUERIES.query
def subgroup_gap(spark, folder):
    out = ev.widest_gap(ev.subgroup_metrics(T.labelled_scores(spark, folder), ["lang", "source"],
                                            0.5))
    return out.select(r9("gap"), "measured", "subgroups")


def training_table(spark, folder):
    """Feature rows joined to the roster, with a label and group columns."""
    matrix = features.feature_matrix(profile_of(spark, folder), CFG)
    roster = T.read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("pid"),
        (F.col("c_acctbal") >= 6000).cast("int").alias("label"),
        ev.age_band((F.col("c_nationkey") * 2 + 18)).alias("age_band"),
        F.col("c_mktsegment").alias("rank"))
    return matrix.join(roster, "pid")


@QUERIES.query
def training_rows(spark, folder):
    names = features.feature_names(CFG)
    return training_table(spark, folder).select(
        "pid", *[F.col(n) for n in names if n.endswith("_slope")], "age_band", "rank",
        F.col("label").cast("bigint").alias("label"))


@QUERIES.query
def training_matrix(spark, folder):
    """The exported matrix: every feature, the group columns and the label, without the person."""
    table = training_table(spark, folder)
    groups = table.select("pid", "age_band", "rank", F.col("label").cast("bigint").alias("label"))
    return sinks.training_matrix(table.select("pid", *features.feature_names(CFG)), groups, CFG)


@QUERIES.query
def driver_topk(spark, folder):
    """Three largest contributions per person under fixed importances."""
    names = features.feature_names(CFG)
    weights = {n: (i + 1) / len(names) for i, n in enumerate(names)}
    matrix = features.feature_matrix(profile_of(spark, folder), CFG)
    rows = ev.top_drivers(matrix, weights, CFG).select("pid", F.posexplode("drivers"))
    return rows.select("pid", F.col("pos").cast("bigint").alias("position"),
                       F.col("col.feature").alias("feature"), r9("col.contribution", "contribution"))


@QUERIES.query
def hazard_horizons(spark, folder):
    rows = T.labelled_scores(spark, folder).select(
        "pid", (F.col("score") / 5).alias("hazard"))
    out = ev.hazard_horizons(rows, "hazard", HORIZONS)
    days = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
            for c in ("median_days", "soonest")]
    return out.select("pid", *[f"risk_{d}d" for d in HORIZONS], *days, "phrase")


ENTRY, INTERVAL = "1996-01-01", min(HORIZONS)


def followed(spark, folder):
    """Customers from one day on, until their first urgent or high order, the last order in the table, or
    the longest horizon; a customer whose balance is overdrawn left after thirty days."""
    orders = T.read(spark, folder, "orders")
    last = F.lit(orders.agg(F.max("o_orderdate")).first()[0]).cast("date")
    entry = F.lit(ENTRY).cast("date")
    people = T.read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("pid"), entry.alias("entry"),
        F.when(F.col("c_acctbal") < 0, F.date_add(entry, 30)).alias("gone")).select(
        "pid", "entry", F.coalesce("gone", last).alias("left"))
    events = orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderdate").cast("date").alias("on"))
    return survival.follow_up(people, events, max(HORIZONS))


def interval_rows(spark, folder):
    roster = T.read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("pid"), F.col("c_mktsegment").alias("rank"))
    return survival.person_intervals(followed(spark, folder).join(roster, "pid"), INTERVAL)


@QUERIES.query
def hazard_life_table(spark, folder):
    """At risk, events, hazard and survival of every interval."""
    return survival.life_table(interval_rows(spark, folder)).select(
        F.col("interval").cast("bigint").alias("interval"), "at_risk", F.col("events").cast("bigint").alias("events"),
        r9("hazard"), r9("survival"))


@QUERIES.query
def hazard_by_stratum(spark, folder):
    """Risk by when for every customer, from the hazard fitted for their stratum."""
    roster = T.read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("pid"), F.col("c_mktsegment").alias("rank"))
    hazard = survival.hazard_by(interval_rows(spark, folder), ["rank"]).select("rank", "hazard")
    out = survival.composed(roster.join(hazard, "rank", "left"))
    days = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("median_days", "soonest")]
    return out.select("pid", r9("hazard"), *[f"risk_{d}d" for d in HORIZONS], *days, "horizon_status")


@QUERIES.query
def hazard_estimates(spark, folder):
    """The boosted hazard on person-interval rows, and the horizons it gives everybody with features."""
    matrix = features.feature_matrix(profile_of(spark, folder), CFG)
    names = features.feature_names(CFG)
    matrix = materialised(matrix.select("pid", *names), "hazard-features")
    rows = survival.person_intervals(followed(spark, folder).join(matrix, "pid"), INTERVAL)
    model = survival.fit(rows.select("pid", *names, "label"), names, "hazard-1")
    return survival.estimate(model, matrix).select(
        "pid", "hazard", *[f"risk_{d}d" for d in HORIZONS], "median_days", "soonest", "phrase", "horizon_status",
        "model_version")


@QUERIES.query
def risk_scores(spark, folder):
    """Boosted trees (all 180 of them) and isotonic calibration, end to end."""
    table = training_table(spark, folder)
    names = features.feature_names(CFG)
    rows = materialised(table.select("pid", *names, "label"), "risk-rows")
    model, _ = models.fit(rows, names, "boosted-1")
    return models.score(model, rows).select("pid", "risk_score", "risk_status", "model_version")


# --------------------------------------------------------------------------- federation ---
def local_parameters(spark, folder):
    """One parameter vector per unit: the mean embedding of its rows."""
    rows = T.read(spark, folder, "embeddings").select(
        F.concat(F.lit("V"), F.col("label").cast("string")).alias("unit_id"),
        F.posexplode("embedding"))
    per = rows.groupBy("unit_id", "pos").agg(
        F.avg(F.col("col").cast("double")).alias("v"), F.count("*").alias("n"))
    # at most one entry per coordinate of the model, whatever the number of rows
    return per.groupBy("unit_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
        .alias("parameters"), F.max("n").alias("n_examples"))


@QUERIES.query
def federated_clip(spark, folder):
    out = federated.unit_deltas(local_parameters(spark, folder), None, FED)
    return out.select("unit_id", "n_examples", r9("norm"), "clipped",
                      F.round(federated.l2(F.col("update")), 9).alias("update_norm"))


@QUERIES.query
def federated_average(spark, folder):
    deltas = federated.unit_deltas(local_parameters(spark, folder), None, FED)
    return federated.average(federated.coordinates(deltas)).select(
        F.col("pos").cast("bigint").alias("pos"), r9("step"))


@QUERIES.query
def federated_noised_average(spark, folder):
    """The same average with the noise every unit adds before it reports."""
    deltas = federated.unit_deltas(local_parameters(spark, folder), None, FED)
    return federated.average(federated.with_noise(deltas, "federation key", 1, FED)).select(
        F.col("pos").cast("bigint").alias("pos"), r9("step"))


def round_reports(spark, folder):
    """Who reported in which round, from the vector numbers."""
    return T.read(spark, folder, "embeddings").select(
        F.lit("c1").alias("campaign"), F.floor(F.col("vec_id") / 7).alias("round"),
        F.concat(F.lit("V"), F.col("label").cast("string")).alias("unit_id"))


@QUERIES.query
def federated_rounds(spark, folder):
    return federated.rounds(round_reports(spark, folder), FED.but(min_participants=5))


@QUERIES.query
def federated_campaign(spark, folder):
    cfg = FED.but(min_participants=5)
    return federated.campaign_report(federated.rounds(round_reports(spark, folder), cfg), cfg)


ROUNDS = 4


def played_campaign(spark, folder):
    """Four rounds over the embeddings: the second hears two units only, the budget covers two rounds."""
    rows = T.read(spark, folder, "embeddings").select(
        F.concat(F.lit("V"), F.col("label").cast("string")).alias("unit_id"), "label",
        (F.col("vec_id") % ROUNDS + 1).alias("round"), F.posexplode("embedding"))
    per = rows.where((F.col("round") != 2) | (F.col("label") < 2)).groupBy("round", "unit_id", "pos").agg(
        F.avg(F.col("col").cast("double")).alias("value"), F.count("*").alias("n_examples"))
    per = materialised(per, "round-reports")
    base = per.select("pos").distinct().withColumn("value", F.lit(0.0))
    cfg = FED.but(min_participants=5, fed_epsilon_total=2 * FED.fed_epsilon_round)
    return federated.play("embeddings", base, [
        per.where(F.col("round") == r).drop("round") for r in range(1, ROUNDS + 1)], cfg)


@QUERIES.query
def federated_history(spark, folder):
    out = played_campaign(spark, folder).table(spark)
    return out.select("campaign", "round", "units", joined("participants"), "completed", r9("epsilon"), r9("spent"),
                      "clipped", "reason")


@QUERIES.query
def federated_vectors(spark, folder):
    """The global vector after every round."""
    found = [v.select(F.lit(i).cast("bigint").alias("round"), F.col("pos").cast("bigint").alias("pos"), r9("value"))
             for i, v in enumerate(played_campaign(spark, folder).vectors, 1)]
    return reduce(DataFrame.unionByName, found)
