"""Adapters from the star-schema test tables to the screening model.

Every adapter is a narrow projection (or one join) over a whole table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.scalar import lookup, strings

EVENTS_AS_OF = date(2024, 1, 30)
LINEITEM_AS_OF = date(2001, 6, 30)
EVENT_DOMAIN = {
    "signup": "self_report", "error": "workload", "click": "duty_roster",
    "purchase": "leave", "view": "training",
}
FULL_VALUE = 100.0
FULL_QUANTITY = 50.0

# One month of events is too short for the default windows.
EVENTS_CONFIG = Config().but(
    domain_tier={"self_report": "T1", "workload": "T2", "duty_roster": "T2", "leave": "T2",
                 "training": "T3"},
    domain_scale={d: FULL_VALUE for d in EVENT_DOMAIN.values()},
    feature_windows=(3, 7, 10, 20), persistence_windows=(3, 7, 10),
    baseline_days=20, baseline_lag=10, min_observations=4, z_self=1.0, z_unit=1.0, breach_z=1.0,
    rhythm_days=30,
    thresholds={"evidence": 0.65, "consistency": 0.70, "persistence": 0.20,
                "actionability": 0.50},
)
FLAG_TIER = {"A": "T2", "N": "T2", "R": "T2", "F": "T3", "O": "T3"}
LINEITEM_CONFIG = Config().but(
    domain_tier=FLAG_TIER, domain_scale={d: FULL_QUANTITY for d in FLAG_TIER})


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def event_domain(kind: Column) -> Column:
    return lookup(EVENT_DOMAIN, kind)


def event_signals(spark: SparkSession, folder: str) -> DataFrame:
    """events -> (pid, unit_id, domain, observed_at, value)."""
    return read(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("pid"),
        F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("unit_id"),
        event_domain(F.col("event_type")).alias("domain"),
        F.col("ts").alias("observed_at"),
        F.least(F.lit(1.0), F.col("value") / FULL_VALUE).alias("value"),
    )


def lineitem_signals(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem x supplier -> two domains per line: the return flag and the line status."""
    supplier = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    lines = read(spark, folder, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")
    return (
        lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
        .select(F.col("l_suppkey").cast("string").alias("pid"),
                F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("unit_id"),
                F.explode(F.array("l_returnflag", "l_linestatus")).alias("domain"),
                F.col("l_shipdate").alias("observed_at"),
                F.least(F.lit(1.0), F.col("l_quantity") / FULL_QUANTITY).alias("value"))
    )


def consent_states(spark: SparkSession, folder: str, cfg: Config = EVENTS_CONFIG) -> DataFrame:
    """customer -> consent: balance and segment stand in for status, contact and scope."""
    everything = list(cfg.domains)
    dropped = {"BUILDING": "training", "FURNITURE": "workload", "HOUSEHOLD": "self_report"}
    segment = F.col("c_mktsegment")
    scope = lookup({s: strings([d for d in everything if d != gone])
                    for s, gone in dropped.items()}, segment, strings(everything))
    revoked = F.col("c_acctbal") < -500
    return read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("pid"),
        F.when(revoked, "REVOKED").when(segment.isin(*dropped), "PARTIAL").otherwise("ACTIVE")
        .alias("status"),
        F.when(revoked, strings(())).otherwise(scope).alias("scope"),
        (~revoked & (F.col("c_acctbal") >= 0)).alias("welfare_contact"))


def raw_event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """events as an untrusted text extract; the counter in ``props`` decides which rows are bad."""
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.col("value").cast("decimal(12,2)").cast("string")
    day = F.date_format("ts", "yyyy-MM-dd")
    return read(spark, folder, "events").select(
        F.when(k < 2, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
        .alias("service_no"),
        F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("unit"),
        F.when(k == 6, F.lit("")).when(k == 8, F.lit("31/01/2024")).otherwise(day).alias("date"),
        F.when(k == 3, F.lit("not-a-number")).when(k == 4, F.concat(F.lit("-"), value))
        .when(k == 5, F.lit("nan")).otherwise(value).alias("value"),
        F.when(k < 50, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k < 60, F.lit("soon")).alias("timestamp"),
        event_domain(F.col("event_type")).alias("domain"))


def assessments(spark: SparkSession, folder: str) -> DataFrame:
    """orders -> questionnaire submissions: the nine digits of the price are the nine answers."""
    digits = F.lpad((F.round(F.col("o_totalprice") * 100)).cast("bigint").cast("string"), 9, "0")
    answers = F.transform(F.split(digits, ""), lambda d: (d.cast("int") % 5))
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("response_id"),
        F.col("o_custkey").cast("string").alias("pid"),
        F.lit("PHQ9").alias("instrument"),
        F.col("o_orderdate").alias("taken_at"),
        answers.alias("answers"))


def close_outs(spark: SparkSession, folder: str) -> DataFrame:
    """orders -> officer close-outs; urgent orders carry a word that is not an outcome."""
    kind = {"1-URGENT": "done", "2-HIGH": "supported", "3-MEDIUM": "not_supported",
            "4-NOT SPECIFIED": "already_known", "5-LOW": "declined_contact"}
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("pid"),
        lookup(kind, F.col("o_orderpriority")).alias("outcome"),
        F.col("o_orderdate").alias("at"))


def surfaced_concerns(spark: SparkSession, folder: str) -> DataFrame:
    """orders -> concerns that surfaced elsewhere, with what had been decided before."""
    verdict = {"F": "monitored", "O": "escalated", "P": "no_flag"}
    channel = {"1-URGENT": "medical_officer", "2-HIGH": "self_referral", "3-MEDIUM": "peer",
               "4-NOT SPECIFIED": "family", "5-LOW": "command"}
    price = F.col("o_totalprice")
    blocking = (F.when(price < 250000, "persistence").when(price < 300000, "evidence")
                .when(price < 350000, "consistency").otherwise(""))
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("concern_id"), F.col("o_custkey").cast("string").alias("pid"),
        F.to_date("o_orderdate").alias("surfaced_on"),
        lookup(channel, F.col("o_orderpriority")).alias("channel"),
        F.when(price < 20000, "not_enrolled")
        .otherwise(lookup(verdict, F.col("o_orderstatus"))).alias("prior_verdict"),
        F.when(F.col("o_orderstatus") == "F", blocking).otherwise("").alias("blocking_gate"))


def labelled_scores(spark: SparkSession, folder: str) -> DataFrame:
    """labels x documents -> (pid, score, label) with two subgroup keys."""
    docs = read(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    return (
        read(spark, folder, "labels").join(docs, "doc_id")
        .select(F.col("doc_id").cast("string").alias("pid"),
                F.round(F.least(F.lit(1.0), F.col("n_chars") / 8000.0), 2).alias("score"),
                F.col("quality").cast("int").alias("label"), "lang", "source"))
