"""The journal replayed in batch, by hand and as a stream whose events arrive out of order."""

import json
import random
from datetime import datetime, timedelta

from conftest import SMALL
from pyspark.sql import functions as F

from vigilframe.operators import intraday
from vigilframe.plans.screening import night_of
from vigilframe.sources import journal
from vigilframe.sources import tables as T
from vigilframe.streaming import replay as live

SCHEMA = "pid STRING, seq BIGINT, at TIMESTAMP, kind STRING, payload STRING"
START = datetime(2024, 1, 1)


def made(pids, n=140):
    rng = random.Random(7)
    rows = []
    for seq in range(n):
        kind = rng.choice(["consent.granted", "consent.granted", "consent.withdrawn", "assessment.submitted",
                           "assessment.submitted", "voice.sitting", "unheard.of"])
        payload = {"consent.granted": {"scope": rng.sample(["self_report", "voice", "leave"], rng.randint(1, 3)),
                                       "welfare_contact": rng.random() < 0.5},
                   "assessment.submitted": {"total": rng.randint(1, 30), "cutoff": 10, "acute": rng.random() < 0.2},
                   "voice.sitting": {"kept": {"jitter": seq / 8}}}.get(kind, {})
        text = json.dumps(payload)
        if rng.random() < 0.1 and kind != "consent.withdrawn":
            text = rng.choice(["{", "{}", ""]) if kind != "voice.sitting" else '{"kept": {}}'
        rows.append((rng.choice(pids), seq, START + timedelta(hours=seq), kind, text))
    return rows + rows[5:9]  # some are there twice


def by_hand(rows):
    folds = {}
    for pid, _, _, kind, payload in sorted(set(rows), key=lambda r: r[1]):
        live.apply(folds.setdefault(pid, {**live.EMPTY, "scope": []}), kind, payload)
    return {pid: tuple(fold[c] for c in live.COLUMNS[1:]) for pid, fold in folds.items()}


def plain(df):
    return {r.pid: tuple(r[c] for c in live.COLUMNS[1:]) for r in df.collect()}


def test_order_of_consent_and_assessment():
    fold = {**live.EMPTY, "scope": []}
    for kind, payload in (("assessment.submitted", {"total": 20, "cutoff": 10}),  # no consent yet
                          ("consent.granted", {"scope": ["self_report"]}),
                          ("assessment.submitted", {"total": 12, "cutoff": 10, "acute": True}),
                          ("consent.withdrawn", {}), ("assessment.submitted", {"total": 30, "cutoff": 10}),
                          ("voice.sitting", {"kept": {"a": 1.0}}), ("assessment.submitted", {})):
        live.apply(fold, kind, json.dumps(payload))
    assert (fold["assessments"], fold["total"], fold["acute"], fold["scope"]) == (1, 12, True, [])
    assert (fold["events"], fold["skipped"], fold["sittings"]) == (7, 1, 0)


def test_batch_equals_the_loop(spark):
    rows = made(["a", "b", "c"])
    assert plain(journal.replayed(spark.createDataFrame(rows, SCHEMA).repartition(4))) == by_hand(rows)


def test_stream_out_of_order_equals_batch(spark, tmp_path):
    rows, rng = made(["a", "b", "c"]), random.Random(3)
    # up to twenty hours late, over five files; a last event far ahead lets everything fall due
    arrival = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 20))
    assert [r[1] for r in arrival] != sorted(r[1] for r in arrival)
    last = [("z", 10_000, START + timedelta(days=400), "consent.withdrawn", "{}")]
    size = -(-len(arrival) // 5)
    for i, part in enumerate([*[arrival[k:k + size] for k in range(0, len(arrival), size)], last]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    events = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
    latest, batches = {}, []

    def keep(df, batch):
        got = plain(df)
        latest.update(got)
        batches.append(len(got))

    query = (live.replay(events).writeStream.outputMode("update").foreachBatch(keep)
             .option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start())
    query.awaitTermination(300)
    assert query.exception() is None
    want = by_hand(rows)
    assert {pid: latest[pid] for pid in want} == want
    assert sum(n > 0 for n in batches) > 1  # folds were handed on before the end


def test_verdicts_are_computed_again(spark):
    """The replayed self-reports decide like the submissions did on the day."""
    night, cfg = night_of(spark, SMALL), T.EVENTS_CONFIG
    scored = intraday.score_responses(T.assessments(spark, SMALL), cfg).where("refused_because IS NULL")
    grants = scored.select("pid").distinct().select(
        "pid", F.lit(-1).cast("bigint").alias("seq"), F.lit("consent.granted").alias("kind"),
        F.lit('{"scope": ["self_report"]}').alias("payload"))
    told = scored.select("pid", F.col("response_id").alias("seq"), F.lit("assessment.submitted").alias("kind"), F.to_json(
        F.struct("total", F.when(F.col("above_cutoff"), F.col("total")).otherwise(F.col("total") + 1).alias("cutoff"),
                 (F.size("acute") > 0).alias("acute"))).alias("payload"))
    again = intraday.decide_again(night.cases, journal.self_reports(journal.replayed(grants.unionByName(told))),
                                  night.fractions, cfg)
    want = intraday.redecide(night.cases, scored, night.fractions, cfg)
    assert sorted(map(tuple, again.select("pid", "decision").collect())) == sorted(
        map(tuple, want.select("pid", "decision").collect()))
