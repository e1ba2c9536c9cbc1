"""Queries about daytime events: questionnaires, alerts and journals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigilframe.functions.scalar import strings
from vigilframe.operators import alerts, intraday, protect, views
from vigilframe.plans.registry import Registry, day, joined, r9, stamp
from vigilframe.plans.screening import night_of
from vigilframe.session import written_folder
from vigilframe.sources import daily_store, journal
from vigilframe.sources import tables as T

QUERIES = Registry()
CFG, AS_OF = T.EVENTS_CONFIG, T.EVENTS_AS_OF


def scored(spark, folder):
    return intraday.score_responses(T.assessments(spark, folder), CFG)


@QUERIES.query
def assessment_scoring(spark, folder):
    return scored(spark, folder).select(
        "response_id", "pid", F.coalesce("refused_because", F.lit("")).alias("refused_because"),
        F.coalesce("total", F.lit(-1)).alias("total"),
        F.coalesce("above_cutoff", F.lit(False)).alias("above_cutoff"))


@QUERIES.query
def acute_routes(spark, folder):
    return intraday.acute_routes(scored(spark, folder), CFG).select(
        "response_id", "pid", joined("acute"), "routed_to", stamp("acknowledge_by"))


@QUERIES.query
def self_report_fold(spark, folder):
    """Case rows after the day's questionnaires, as they enter the gates."""
    night = night_of(spark, folder)
    merged = intraday.fold(night.cases, intraday.latest_per_person(scored(spark, folder)),
                           night.fractions, CFG)
    rows = merged.select("pid", joined("acute_items"), F.inline("deviations"))
    return rows.filter(F.col("domain") == "self_report").select(
        "pid", "acute_items", r9("z_self"), r9("z_unit"), "windows_breached",
        *[F.coalesce(F.round(f"breach_{i}", 9), F.lit(-1.0)).alias(f"breach_{i}")
          for i in range(3)])


@QUERIES.query
def intraday_verdicts(spark, folder):
    """Everyone who submitted, decided again; nobody is decided by their night verdict alone."""
    night = night_of(spark, folder)
    out = intraday.redecide(night.cases, scored(spark, folder), night.fractions, CFG)
    return out.select("pid", "decision", "reason", joined("recommended"), r9("evidence"),
                      r9("consistency"), r9("persistence"), r9("actionability"))


def redecided(spark, folder):
    night = night_of(spark, folder)
    return intraday.redecide(night.cases, scored(spark, folder), night.fractions, CFG)


@QUERIES.query
def acute_records(spark, folder):
    """The override entry of every acute submission, with the gates it bypassed."""
    told = scored(spark, folder)
    out = intraday.override_records(intraday.acute_routes(told, CFG), redecided(spark, folder), CFG)
    return out.select("action", "subject_pid", "unit_id", "response_id", "acute_items",
                      "bypassed_gates", "routed_to", F.col("acknowledge_by_hours").cast("bigint")
                      .alias("acknowledge_by_hours"), stamp("at"))


@QUERIES.query
def alerts_queued(spark, folder):
    now = F.lit("2024-01-31 02:00:00").cast("timestamp_ntz")
    out = alerts.enqueue(redecided(spark, folder), now)
    return out.select("pid", "unit_id", "priority", "route_to", "intervention", "reason",
                      stamp("deliver_after"))


@QUERIES.query
def alerts_shadow(spark, folder):
    out = alerts.shadow_log(redecided(spark, folder))
    return out.groupBy("action", "would_have_alerted").agg(F.count("*").alias("n"))


def alert_log(spark, folder):
    p = F.col("o_orderpriority")
    return T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("seq"),
        F.when(p.isin("1-URGENT", "2-HIGH"), "enqueue").when(p == "5-LOW", "cancel")
        .otherwise("deliver").alias("kind"))


@QUERIES.query
def alerts_final(spark, folder):
    """What is left of a day of queueing, deliveries and withdrawals."""
    return alerts.replay(alert_log(spark, folder)).select(
        "pid", "seq", F.coalesce("delivered_seq", F.lit(-1)).alias("delivered_seq"))


@QUERIES.query
def alerts_pending(spark, folder):
    left = alerts.replay(alert_log(spark, folder)).withColumn(
        "delivered_at", F.col("delivered_seq")).withColumn(
        "unit_id", F.concat(F.lit("U"), (F.col("pid").cast("bigint") % 10).cast("string")))
    return alerts.pending(left).groupBy("unit_id").agg(F.count("*").alias("n"))


@QUERIES.query
def journal_replay(spark, folder):
    """Sealed events of the current epoch, opened and folded per person."""
    key = b"0123456789abcdef0123456789abcdef"
    rows = scored(spark, folder).filter("refused_because IS NULL").select(
        F.col("response_id").alias("seq"), F.lit("assessment.submitted").alias("kind"), "pid",
        F.when(F.col("taken_at") < "2001-01-01", "E0001").otherwise("E0002").alias("salt_epoch"),
        F.to_json(F.struct("total", "cutoff", (F.size("acute") > 0).alias("acute"))).alias("body"))
    # a third of the rows are bound to somebody else and will not open
    bound = F.when(F.col("seq") % 3 == 0, F.concat("pid", F.lit("-moved"))).otherwise(F.col("pid"))
    sealed = rows.withColumn("sealed", protect.seal(F.col("body"), F.lit(key), bound)).drop("body")
    opened = journal.readable(sealed, key, "E0001")
    return journal.assessments(opened).groupBy("pid").agg(
        F.count("*").alias("events"), F.max("total").alias("total"),
        F.max_by("acute", "seq").alias("acute"))


@QUERIES.query
def journal_replay_kinds(spark, folder):
    """Consents, withdrawals, assessments, sittings and unusable events, applied in their order."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    whole = F.floor("o_totalprice")
    scope = F.when(s == "F", strings(("self_report", "voice"))).when(s == "O", strings(("self_report",))).otherwise(
        strings(("voice",)))
    payload = (
        F.when(p == "1-URGENT", F.to_json(F.struct(scope.alias("scope"), (s == "F").alias("welfare_contact"))))
        .when(p == "2-HIGH", F.lit("{}"))
        .when(p == "3-MEDIUM", F.to_json(F.struct(
            (whole % 31).alias("total"), F.lit(20).alias("cutoff"), (whole % 7 == 0).alias("acute"))))
        .when(p == "4-NOT SPECIFIED", F.to_json(F.struct(F.struct(whole.cast("double").alias("level")).alias("kept"))))
        .otherwise(F.lit("{")))
    kind = (F.when(p == "1-URGENT", "consent.granted").when(p == "2-HIGH", "consent.withdrawn")
            .when(p == "4-NOT SPECIFIED", "voice.sitting").otherwise("assessment.submitted"))
    events = T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("seq"), kind.alias("kind"),
        payload.alias("payload"))
    return journal.replayed(events).select(
        "pid", "events", "skipped", F.array_join("scope", ",").alias("scope"), "welfare_contact", "assessments",
        F.coalesce("total", F.lit(-1)).alias("total"), "above_cutoff", "acute", "sittings",
        F.coalesce(F.col("voice")["level"], F.lit(-1.0)).alias("level"))


@QUERIES.query
def driver_phrases(spark, folder):
    """Feature names of every domain and window in the words shown to the person."""
    names = [F.lit(s) for s in ("_mean_7d", "_mean_30d", "_mean_90d", "_mean_180d", "_slope")]
    domains = T.event_signals(spark, folder).groupBy("domain").agg(F.count("*").alias("n"))
    rows = domains.select("n", F.explode(F.array(*[F.concat("domain", s) for s in names]))
                          .alias("feature"))
    return rows.select("feature", "n", views.plain_driver(F.col("feature")).alias("plain"))


@QUERIES.query
def daily_tumbling(spark, folder):
    """Batch twin of the streaming daily table: one-day tumbling windows."""
    rows = T.event_signals(spark, folder).groupBy(
        F.window(F.col("observed_at").cast("timestamp"), "1 day").alias("w"), "pid", "domain").agg(
        F.avg("value").alias("value"), F.count("*").alias("n"))
    return rows.select("pid", "domain", F.date_format("w.start", "yyyy-MM-dd").alias("day"),
                       r9("value"), "n")


@QUERIES.query
def daily_store_values(spark, folder):
    """Days read back from the mergeable store: three batches in disorder, one handed over twice, half of
    the days compacted in between."""
    signals = T.event_signals(spark, folder).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    path = f"{written_folder(spark)}/store-{uuid.uuid4().hex}"
    batch = F.crc32(F.concat_ws("/", "pid", "domain", "observed_at").cast("binary")) % 3
    for number in (2, 0, 2):
        daily_store.append(signals.where(batch == number), path, number)
    daily_store.compact(spark, path)
    daily_store.append(signals.where(batch == 1), path, 3)
    rows = daily_store.merged(daily_store.stored(spark, path)).groupBy("pid", "domain", "day").agg(
        (F.sum("total") / F.sum("n")).alias("value"), F.sum("n").alias("n"))
    return rows.select("pid", "domain", day("day"), r9("value"), "n")
