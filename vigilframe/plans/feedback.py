"""Queries about outcomes, missed cases, drift and threshold proposals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vigilframe.functions.scalar import lookup
from vigilframe.operators import evaluation as ev
from vigilframe.operators import feedback as fb
from vigilframe.plans.registry import Registry, day, joined, r9
from vigilframe.sources import tables as T

QUERIES = Registry()
CFG = T.EVENTS_CONFIG
SINCE = date(1997, 1, 1)
REVIEW_DAY = date(1998, 6, 30)


def latest(spark, folder):
    return fb.latest_closes(T.close_outs(spark, folder))


def contests(spark, folder):
    kind = {"F": "factual_error", "O": "benign_explanation", "P": "objects_to_analysis"}
    driver = {"1-URGENT": "leave", "2-HIGH": "workload", "3-MEDIUM": "training",
              "4-NOT SPECIFIED": "duty_roster", "5-LOW": "self_report"}
    rows = T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("seq"),
        lookup(kind, F.col("o_orderstatus")).alias("kind"),
        lookup(driver, F.col("o_orderpriority")).alias("driver"),
        (F.col("o_totalprice") < 400000).alias("accepted"), F.to_date("o_orderdate").alias("on"))
    return fb.contest_routes(rows, CFG)


@QUERIES.query
def close_outs_refused(spark, folder):
    return fb.rejected_closes(T.close_outs(spark, folder)).groupBy("outcome").agg(
        F.count("*").alias("n"))


@QUERIES.query
def close_outs_latest(spark, folder):
    return latest(spark, folder)


@QUERIES.query
def deferrals(spark, folder):
    """A deferral without a reason is refused; the reasons are the conversation texts."""
    rows = T.read(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("pid"), F.col("turn"),
        F.when(F.col("role") == "system", "  ").otherwise(F.col("text")).alias("reason"))
    return fb.deferrals(rows).groupBy("pid", "refused").agg(F.count("*").alias("n"))


@QUERIES.query
def blocking_cases(spark, folder):
    escalated = T.read(spark, folder, "customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").cast("string").alias("pid"))
    contacted = T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"))
    closed = fb.valid_closes(T.close_outs(spark, folder)).filter("outcome = 'supported'")
    return fb.blocking(escalated, contacted, closed)


@QUERIES.query
def contest_routing(spark, folder):
    return contests(spark, folder).select(
        "pid", "seq", "route", "action",
        F.coalesce(F.date_format("expires_on", "yyyy-MM-dd"), F.lit("")).alias("expires_on"))


@QUERIES.query
def suppressed_drivers(spark, folder):
    return fb.suppressed_drivers(contests(spark, folder), REVIEW_DAY).select(
        "pid", joined("suppressed_drivers"))


@QUERIES.query
def realised_precision(spark, folder):
    return fb.realised_precision(latest(spark, folder)).select(r9("precision"), "judged")


@QUERIES.query
def outcome_counts(spark, folder):
    return fb.outcome_counts(latest(spark, folder))


@QUERIES.query
def weekly_report(spark, folder):
    return fb.weekly_report(latest(spark, folder), contests(spark, folder))


# ------------------------------------------------------------------------ missed cases ---
@QUERIES.query
def surfaced_report(spark, folder):
    out = fb.surfaced_report(T.surfaced_concerns(spark, folder), SINCE)
    return out.select("surfaced", "missed", "already_escalated", "not_enrolled", "recoverable",
                      r9("missed_rate"), r9("surfaced_recall"), "dominant_gate")


@QUERIES.query
def surfaced_by_channel(spark, folder):
    return fb.by_category(T.surfaced_concerns(spark, folder), "channel")


@QUERIES.query
def surfaced_by_gate(spark, folder):
    return fb.by_category(T.surfaced_concerns(spark, folder), "blocking_gate")


@QUERIES.query
def prior_verdicts(spark, folder):
    """What the run before each concern had decided (as-of join)."""
    orders = T.read(spark, folder, "orders")
    at = F.to_date("o_orderdate").alias("at")
    pid = F.col("o_custkey").cast("string").alias("pid")
    concerns = orders.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("concern_id"), pid, at)
    history = orders.filter("o_orderpriority <> '1-URGENT'").select(
        pid, at, F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("verdict"),
        F.col("o_totalprice").alias("shortfall"))
    out = fb.prior_state(concerns, history, ["verdict", "shortfall"])
    return out.select("concern_id", "pid", day("at"),
                      F.coalesce(F.date_format("prior_at", "yyyy-MM-dd"), F.lit("")).alias(
                          "prior_at"),
                      F.coalesce("prior_verdict", F.lit("not_enrolled")).alias("prior_verdict"),
                      F.coalesce(F.round("prior_shortfall", 2), F.lit(0.0)).alias("shortfall"))


# --------------------------------------------------------------------------- proposals ---
@QUERIES.query
def tightening_proposals(spark, folder):
    report = fb.weekly_report(latest(spark, folder), contests(spark, folder))
    surfaced = fb.surfaced_report(T.surfaced_concerns(spark, folder))
    return fb.propose(report, surfaced, CFG.but(precision_floor=0.70)).select(
        "gate", r9("current"), r9("proposed"), "direction", "rationale")


@QUERIES.query
def loosening_proposals(spark, folder):
    """The other direction, with a floor that the realised precision clears."""
    report = fb.weekly_report(latest(spark, folder), contests(spark, folder))
    surfaced = fb.surfaced_report(T.surfaced_concerns(spark, folder))
    return fb.propose(report, surfaced, CFG.but(precision_floor=0.30)).select(
        "gate", r9("current"), r9("proposed"), "direction", "rationale")


@QUERIES.query
def subgroup_proposals(spark, folder):
    metrics = ev.subgroup_metrics(T.labelled_scores(spark, folder), ["lang", "source"], 0.5)
    return fb.subgroup_proposals(metrics, CFG.but(precision_floor=0.90)).select(
        "gate", "current", "proposed", "rationale")


@QUERIES.query
def board_decisions(spark, folder):
    """Thresholds after the board approved one proposal and turned the other down."""
    report = fb.weekly_report(latest(spark, folder), contests(spark, folder))
    proposals = fb.propose(report, None, CFG)
    decisions = fb.outcome_counts(latest(spark, folder)).select(
        F.when(F.col("outcome") == "supported", "evidence").otherwise("consistency").alias("gate"),
        F.when(F.col("outcome") == "supported", F.col("n") > 0).otherwise(False).alias("approved")
    ).distinct()
    return fb.apply_decisions(proposals, decisions, CFG).select(
        "gate", r9("before"), r9("after"))


@QUERIES.query
def score_drift(spark, folder):
    """Stability of the order book's scores between two halves of the years."""
    rows = T.read(spark, folder, "orders").select(
        F.when(F.col("o_orderdate") < "1998-06-01", "baseline").otherwise("current").alias("side"),
        (F.col("o_totalprice") / 450000).alias("score"))
    return fb.stability(rows, CFG)


@QUERIES.query
def score_drift_frozen(spark, folder):
    """A distribution that moved far enough to freeze escalation."""
    docs = T.read(spark, folder, "documents").select(
        F.when(F.col("lang") == "en", "baseline").otherwise("current").alias("side"),
        F.when(F.col("lang") == "en", F.col("n_chars") / 8000.0)
        .otherwise(F.col("n_chars") / 30000.0).alias("score"))
    return fb.stability(docs, CFG)
