"""Streams drained with availableNow against their batch twins."""

from datetime import datetime

import pytest
from conftest import SMALL
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vigilframe.operators import alerts, intraday, protect
from vigilframe.plans import intraday as queries
from vigilframe.plans.screening import night_of
from vigilframe.plans.voice import CFG as VOICE
from vigilframe.sources import journal as journal_rows
from vigilframe.sources import tables as T
from vigilframe.streaming import alerts as live_alerts
from vigilframe.streaming import assessments, daily, journal, voice


def stream_of(spark, df, path, files=3):
    df.repartition(files).write.mode("overwrite").parquet(path)
    return (spark.readStream.schema(spark.read.parquet(path).schema)
            .option("maxFilesPerTrigger", 1).parquet(path))


def drain(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(
        availableNow=True).start()
    query.awaitTermination(240)
    return df.sparkSession.table(name)


def test_daily_table(spark, tmp_path):
    signals = T.event_signals(spark, SMALL).withColumn(
        "observed_at", F.col("observed_at").cast("timestamp"))
    path = str(tmp_path / "in")
    signals.coalesce(1).write.parquet(path)
    live = spark.readStream.schema(signals.schema).parquet(path)
    query = daily.append_daily(live, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = signals.groupBy("pid", "domain", F.to_date("observed_at").alias("day")).agg(
        F.avg("value").alias("value"), F.count("*").alias("rows"))
    last = signals.agg(F.max(F.to_date("observed_at"))).first()[0]
    closed = batch.filter(F.col("day") < F.date_sub(F.lit(last), 2))
    joined = closed.join(got.withColumnRenamed("value", "v").withColumnRenamed("rows", "r"),
                         ["pid", "domain", "day"])
    assert closed.count() > 0
    assert joined.filter((F.abs(F.col("v") - F.col("value")) < 1e-9)
                         & (F.col("r") == F.col("rows"))).count() == closed.count()


def test_assessments_are_recorded_routed_and_decided(spark, tmp_path):
    night = night_of(spark, SMALL)
    cfg = T.EVENTS_CONFIG
    responses = stream_of(spark, T.assessments(spark, SMALL), str(tmp_path / "in"), 1)
    out = {n: str(tmp_path / n) for n in ("ledger", "routes", "verdicts", "queue")}
    body = assessments.handler(night.cases, night.fractions, cfg,
                               **{n: assessments.write_batch(p) for n, p in out.items()},
                               now=datetime(2024, 1, 31, 2, 0))
    assessments.follow(responses, body, str(tmp_path / "ckpt")).awaitTermination(240)
    scored = intraday.score_responses(T.assessments(spark, SMALL), cfg)
    assert spark.read.parquet(out["ledger"]).count() == scored.filter(
        "refused_because IS NULL").count()
    assert "answers" not in spark.read.parquet(out["ledger"]).columns
    assert spark.read.parquet(out["routes"]).count() == intraday.acute_routes(scored, cfg).count()
    want = {r.pid: r.decision for r in intraday.redecide(
        night.cases, scored, night.fractions, cfg).select("pid", "decision").collect()}
    got = {r.pid: r.decision for r in spark.read.parquet(out["verdicts"]).collect()}
    assert got == want and want
    named = {p for p, d in want.items() if d.endswith("ESCALATE")}
    assert {r.pid for r in spark.read.parquet(out["queue"]).collect()} == named


def test_nothing_is_routed_without_a_ledger(spark, tmp_path):
    night = night_of(spark, SMALL)
    responses = stream_of(spark, T.assessments(spark, SMALL), str(tmp_path / "in"), 1)

    def broken(rows, batch):
        raise OSError("ledger is down")

    seen = []
    body = assessments.handler(
        night.cases, night.fractions, T.EVENTS_CONFIG, ledger=broken,
        routes=lambda rows, b: seen.append("route"), verdicts=lambda rows, b: seen.append("verdict"),
        unrecorded=assessments.write_batch(str(tmp_path / "manual")))
    with pytest.raises(StreamingQueryException):  # the batch is not committed: nothing is lost
        assessments.follow(responses, body, str(tmp_path / "ckpt")).awaitTermination(240)
    manual = spark.read.parquet(str(tmp_path / "manual"))
    assert seen == [] and manual.count() > 0
    assert "NOT been routed" in manual.first().message


def test_alert_queue_state(spark, tmp_path):
    log = queries.alert_log(spark, SMALL)
    path = str(tmp_path / "in")
    # files are read in the order they were written, so events arrive in sequence
    bounds = [r[0] for r in log.selectExpr("percentile(seq, array(0.33, 0.66))").collect()][0]
    for i, part in enumerate((f"seq <= {bounds[0]}", f"seq > {bounds[0]} AND seq <= {bounds[1]}",
                              f"seq > {bounds[1]}")):
        log.filter(part).coalesce(1).write.parquet(f"{path}/part={i}")
    live = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(path))
    got = {(r.pid, r.seq, r.delivered_seq)
           for r in drain(live_alerts.deliveries(live), "served").collect()}
    want = {(r.pid, r.seq, r.delivered_seq) for r in alerts.replay(log).filter(
        "delivered_seq IS NOT NULL").collect()}
    assert got == want and want


def test_claims_meet_frames_within_the_window(spark, tmp_path):
    at = "timestamp_seconds(1700000000 + t)"
    said = spark.createDataFrame([("s", "u1", 100, "hello"), ("s", "u2", 400, "x"),
                                  ("other", "u3", 100, "y")],
                                 "session_id STRING, utterance_id STRING, t INT, text STRING"
                                 ).withColumn("said_at", F.expr(at)).drop("t")
    rows = [("s", t, 1.0, 0.8, *[0.5] * 6) for t in (40, 56, 100, 145, 146, 300)]
    rows.append(("s", 101, 1.0, 0.1, *[0.5] * 6))
    names = ", ".join(f"{b[0]} DOUBLE" for b in VOICE.bands)
    heard = spark.createDataFrame(
        rows, f"session_id STRING, t INT, duration_s DOUBLE, voiced_fraction DOUBLE, {names}"
    ).withColumn("heard_at", F.expr(at)).drop("t")
    cfg = VOICE.but(gap_window_ms=45_000)
    out = voice.claims_with_frames(stream_of(spark, said, str(tmp_path / "u"), 1),
                                   stream_of(spark, heard, str(tmp_path / "f"), 1), cfg)
    assert "text" not in out.columns
    got = sorted((r.utterance_id, int(r.heard_at.timestamp()) - 1700000000)
                 for r in drain(out, "near").collect())
    assert got == [("u1", 56), ("u1", 100), ("u1", 145)]


def test_sittings_close_after_silence(spark, tmp_path):
    names = ", ".join(f"{b[0]} DOUBLE" for b in VOICE.bands)
    rows = [("p", t, 1.0, 0.8, *[float(t)] * 6) for t in (0, 60, 120, 9000, 9060, 90000)]
    heard = spark.createDataFrame(
        rows, f"pid STRING, t INT, duration_s DOUBLE, voiced_fraction DOUBLE, {names}").withColumn(
        "heard_at", F.expr("timestamp_seconds(1700000000 + t)")).drop("t")
    live = voice.sittings(stream_of(spark, heard, str(tmp_path / "f"), 1), VOICE)
    got = sorted((r.windows, r.jitter_local) for r in drain(live, "closed").collect())
    assert got == [(2, 9030.0), (3, 60.0)]


def test_journal_stream(spark, tmp_path):
    key = b"0123456789abcdef0123456789abcdef"
    events = spark.createDataFrame(
        [(1, "a", "E1", 12, False), (2, "a", "E1", 9, True), (3, "b", "E0", 20, True),
         (4, "c", "E1", 15, False)],
        "seq BIGINT, pid STRING, salt_epoch STRING, total BIGINT, acute BOOLEAN")
    bound = F.when(F.col("pid") == "c", F.lit("a")).otherwise(F.col("pid"))
    body = F.to_json(F.struct("total", F.lit(10).alias("cutoff"), "acute"))
    sealed = events.select(
        "seq", F.current_timestamp().alias("at"), F.lit("assessment.submitted").alias("kind"),
        "pid", "salt_epoch", protect.seal(body, F.lit(key), bound).alias("sealed"))
    path = str(tmp_path / "j")
    sealed.write.parquet(path)
    batch = journal_rows.assessments(journal_rows.readable(spark.read.parquet(path), key, "E1"))
    assert {r.seq for r in batch.collect()} == {1, 2}
    rows = []
    journal.follow(journal.read(spark, path), key, "E1",
                   lambda df, b: rows.extend(df.collect()),
                   str(tmp_path / "ckpt")).awaitTermination(240)
    assert {(r.pid, r.events, r.total, r.acute) for r in rows} == {("a", 2, 12, True)}


def test_later_batches_count_the_earlier_ones_and_the_freeze(spark, tmp_path):
    night, cfg = night_of(spark, SMALL), T.EVENTS_CONFIG
    rows = T.assessments(spark, SMALL).cache()
    middle = rows.approxQuantile("response_id", [0.5], 0)[0] if dict(rows.dtypes)["response_id"] != "string" \
        else sorted(r.response_id for r in rows.select("response_id").collect())[rows.count() // 2]
    first, second = rows.filter(F.col("response_id") < middle), rows.filter(F.col("response_id") >= middle)
    got = {}

    def keep(decided, batch):
        got.update({r.pid: r.decision for r in decided.select("pid", "decision").collect()})

    def run(frozen):
        got.clear()
        body = assessments.handler(
            night.cases, night.fractions, cfg, ledger=lambda r, b: None, routes=lambda r, b: None,
            verdicts=keep, earlier=lambda batch: first if batch else rows.limit(0), frozen=frozen)
        body(first, 0)
        body(second, 1)
        return dict(got)

    want = {r.pid: r.decision for r in intraday.redecide(
        night.cases, intraday.score_responses(rows, cfg), night.fractions, cfg).select(
        "pid", "decision").collect()}
    assert run(False) == want
    named = {p for p, d in want.items() if d == "ESCALATE"}
    assert all(d != "ESCALATE" for d in run(True).values()) or not named
