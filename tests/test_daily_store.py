"""The daily store: any order, late rows, repeated batches, compaction and ageing give what raw rows give."""

from datetime import timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vigilframe.operators import features
from vigilframe.plans.nightly import nightly
from vigilframe.sources import daily_store
from vigilframe.sources import tables as T
from vigilframe.streaming import daily

AS_OF, CFG = T.EVENTS_AS_OF, T.EVENTS_CONFIG


@pytest.fixture(scope="module")
def signals(spark):
    return T.event_signals(spark, SMALL).withColumn("observed_at", F.col("observed_at").cast("timestamp")).cache()


def parts_of(df):
    return {(r.pid, r.domain, str(r.day), r.unit_id): (round(r.total, 9), r.n, r.seen) for r in df.collect()}


def filled(signals, path):
    """Three batches: what is on time, what comes ten days late, and the rest in disorder."""
    late = (F.crc32(F.concat("pid", F.col("observed_at").cast("string")).cast("binary")) % 3)
    for batch in (2, 0, 1):
        daily_store.append(signals.where(late == batch), path, batch)


def test_parts_in_any_order_equal_raw_rows(spark, signals, tmp_path):
    path = str(tmp_path / "store")
    filled(signals, path)
    want = parts_of(features.daily_parts(signals))
    assert parts_of(daily_store.merged(daily_store.stored(spark, path))) == want
    daily_store.append(signals.where("pid < '3'"), path, 7)
    daily_store.append(signals.limit(0), path, 8)
    filled(signals, path)  # all three batches are handed over again: nothing counts twice
    twice = parts_of(features.daily_parts(signals.unionByName(signals.where("pid < '3'"))))
    assert parts_of(daily_store.merged(daily_store.stored(spark, path))) == twice


def test_compaction_and_tidying(spark, signals, tmp_path):
    path = str(tmp_path / "store")
    filled(signals, path)
    want = parts_of(features.daily_parts(signals))
    done = daily_store.compact(spark, path).collect()
    assert done and all(r.parts >= 2 for r in done)
    assert parts_of(daily_store.merged(daily_store.stored(spark, path))) == want
    assert daily_store.compact(spark, path).count() == 0
    late = signals.where(F.col("observed_at") < "2024-01-05")
    daily_store.append(late, path, 9)  # late rows over compacted days
    more = parts_of(features.daily_parts(signals.unionByName(late)))
    assert parts_of(daily_store.merged(daily_store.stored(spark, path))) == more
    assert daily_store.tidy(spark, path) > 0
    assert parts_of(daily_store.merged(daily_store.stored(spark, path))) == more
    assert {r.day.isoformat() for r in daily_store.compact(spark, path).collect()} <= {f"2024-01-0{i}" for i in range(1, 5)}
    daily_store.tidy(spark, path)
    assert parts_of(daily_store.merged(daily_store.stored(spark, path))) == more


def test_ageing_drops_whole_days(spark, signals, tmp_path):
    path = str(tmp_path / "store")
    filled(signals, path)
    border = AS_OF - timedelta(days=12)
    gone = {r.day: r.rows for r in daily_store.age_out(spark, path, AS_OF, 12).collect()}
    want = {r.day: r.n for r in signals.groupBy(F.to_date("observed_at").alias("day")).agg(
        F.count("value").alias("n")).collect() if r.day < border}
    assert gone == want and want
    kept = signals.where(F.to_date("observed_at") >= F.lit(border))
    assert parts_of(daily_store.merged(daily_store.stored(spark, path))) == parts_of(features.daily_parts(kept))


def test_history_prunes_by_folder(spark, signals, tmp_path):
    path = str(tmp_path / "store")
    filled(signals, path)
    plan = daily_store.history(spark, path, AS_OF, 7)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_stream_with_late_rows_feeds_the_night(spark, signals, tmp_path):
    """Rows of the first days arrive last, ten days and more behind; the night is that of the raw rows."""
    border = (AS_OF - timedelta(days=10)).isoformat()
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    slow = F.crc32(F.col("pid").cast("binary")) % 4 == 0
    for i, part in enumerate((~slow & (F.col("observed_at") < border), F.col("observed_at") >= border,
                              slow & (F.col("observed_at") < border))):
        signals.where(part).coalesce(1).write.mode("append").parquet(f"{source}/part={i}")
    live = (spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(source))
    query = daily.into_store(live, path, str(tmp_path / "ckpt"))
    query.awaitTermination(240)
    assert query.exception() is None
    daily_store.compact(spark, path)
    consent = T.consent_states(spark, SMALL)
    keep = ("pid", "unit_id", "decision", "reason", "evidence", "consistency", "persistence", "actionability")

    def night(rows):
        return sorted(map(tuple, nightly(rows, consent, AS_OF, CFG, detail=False).verdicts.select(
            "pid", "unit_id", "decision", "reason", *[F.round(c, 9) for c in keep[4:]]).collect()), key=str)

    got = night(daily_store.history(spark, path, AS_OF, CFG.history_days))
    assert got == night(signals) and got
