"""The sealed, append-only journal of what people did."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.operators.protect import unseal

ASSESSMENT = "total BIGINT, cutoff BIGINT, acute BOOLEAN"
CONSENT = "scope ARRAY<STRING>, welfare_contact BOOLEAN, locale STRING"
SITTING = "kept MAP<STRING,DOUBLE>, windows_measured INT, produced_deviation BOOLEAN"
SCHEMA = "seq BIGINT, at TIMESTAMP, kind STRING, pid STRING, salt_epoch STRING, sealed BINARY"


def readable(journal: DataFrame, key: bytes, salt_epoch: str) -> DataFrame:
    """Events of the current epoch that open for their own person.

    A row that will not open was moved, altered or sealed under another key: it is skipped here and
    stays in the table for an auditor.
    """
    current = journal.filter(F.col("salt_epoch") == salt_epoch)
    body = unseal(F.col("sealed"), F.lit(key), F.col("pid"))
    return current.withColumn("payload", body).filter(F.col("payload").isNotNull()).drop("sealed")


def assessments(events: DataFrame) -> DataFrame:
    rows = events.filter(F.col("kind") == "assessment.submitted")
    return rows.withColumn("p", F.from_json("payload", ASSESSMENT)).select("seq", "pid", "p.*")


def sittings(events: DataFrame) -> DataFrame:
    rows = events.filter(F.col("kind") == "voice.sitting")
    return rows.withColumn("p", F.from_json("payload", SITTING)).select("seq", "pid", "p.*")


def consents(events: DataFrame) -> DataFrame:
    """Grants and withdrawals in the shape the consent fold reads."""
    rows = events.filter(F.col("kind").isin("consent.granted", "consent.withdrawn"))
    p = F.from_json("payload", CONSENT)
    return rows.select(
        "pid", "seq", F.when(F.col("kind") == "consent.granted", "enrol").otherwise("revoke")
        .alias("kind"), p["scope"].alias("domains"), p["welfare_contact"].alias("contact"))


ANY = ("scope ARRAY<STRING>, welfare_contact BOOLEAN, total BIGINT, cutoff BIGINT, acute BOOLEAN, "
       "kept MAP<STRING,DOUBLE>")
SELF_REPORT, VOICE = "self_report", "voice"


def replayed(events: DataFrame) -> DataFrame:
    """Opened events of all kinds (pid, seq, kind, payload), applied per person in the order of ``seq``.

    An assessment or a sitting counts only under the consent in force when it was made, so a later grant
    or withdrawal changes nothing about it.  An event whose payload cannot be used is skipped and counted;
    an event that is there twice counts once.  Nothing decided is in the journal: verdicts are computed
    again from the fold (``self_reports``).
    """
    rows = events.dropDuplicates(["pid", "seq"]).withColumn("p", F.from_json("payload", ANY))
    kind = F.col("kind")
    usable = F.coalesce(
        F.when(kind == "consent.granted", F.col("p.scope").isNotNull())
        .when(kind == "consent.withdrawn", F.lit(True))
        .when(kind == "assessment.submitted", F.col("p.total").isNotNull())
        .when(kind == "voice.sitting", F.size("p.kept") > 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    granted, withdrawn = (F.col("usable") & (kind == f"consent.{x}") for x in ("granted", "withdrawn"))
    given = F.when(granted, F.col("p.scope")).when(withdrawn, F.array().cast("array<string>"))
    # a person's own events, made by hand: a window over one person is short
    order = Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.coalesce(
        F.last(given, ignorenulls=True).over(order), F.array().cast("array<string>")))
    told = F.col("usable") & (kind == "assessment.submitted") & F.array_contains("scope", SELF_REPORT)
    heard = F.col("usable") & (kind == "voice.sitting") & F.array_contains("scope", VOICE)
    return rows.groupBy("pid").agg(
        F.count("*").alias("events"), F.count_if(~F.col("usable")).alias("skipped"),
        F.max_by("scope", "seq").alias("scope"),
        F.coalesce(F.max_by(F.col("p.welfare_contact"), F.when(granted, F.col("seq"))), F.lit(False)).alias("welfare_contact"),
        F.count_if(told).alias("assessments"), F.max(F.when(told, F.col("p.total"))).alias("total"),
        F.coalesce(F.bool_or(F.when(told, F.col("p.total") >= F.col("p.cutoff"))), F.lit(False)).alias("above_cutoff"),
        F.coalesce(F.max_by(F.col("p.acute"), F.when(told, F.col("seq"))), F.lit(False)).alias("acute"),
        F.count_if(heard).alias("sittings"),
        F.max_by(F.col("p.kept"), F.when(heard, F.col("seq"))).alias("voice"))


def self_reports(replay: DataFrame) -> DataFrame:
    """What ``intraday.fold`` reads, of the people whose assessments count."""
    acute = F.when(F.col("acute"), F.array(F.lit("replayed"))).otherwise(F.array().cast("array<string>"))
    return replay.where("assessments > 0").select(
        "pid", "total", "above_cutoff", acute.alias("acute"), F.col("assessments").alias("submissions"))
