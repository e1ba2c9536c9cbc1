"""Windows, baselines and deviations against plain Python, and under skew."""

import random
import statistics
from datetime import date, timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.median import grouped_median
from vigilframe.operators import deviation, features, rhythm
from vigilframe.plans.nightly import nightly, screen
from vigilframe.sources import tables as T

CFG = Config()
AS_OF = date(2026, 9, 5)
SCHEMA = "pid STRING, domain STRING, unit_id STRING, value DOUBLE, observed_at TIMESTAMP"


def signals(spark, rows):
    return spark.createDataFrame([
        (pid, domain, unit, float(value), _at(offset, hour))
        for pid, domain, unit, value, offset, hour in rows], SCHEMA)


def _at(offset, hour=0):
    from datetime import datetime, timezone

    day = AS_OF - timedelta(days=offset)
    return datetime(day.year, day.month, day.day, hour, tzinfo=timezone.utc)


def spike(pid, domain="workload", unit="U1"):
    rows = [(pid, domain, unit, 0.2 + (0.02 if o % 2 else -0.02), o, 0) for o in range(90, 270)]
    rows += [(pid, domain, unit, 0.2, o, 0) for o in range(7, 90)]
    return rows + [(pid, domain, unit, 0.9, o, 0) for o in range(7)]


def test_spike_deviates_from_the_lagged_baseline(spark):
    _, profile = screen(signals(spark, spike("p1")), AS_OF, CFG)
    row = deviation.deviations(profile, CFG).first()
    sd = max(statistics.pstdev([0.18, 0.22]), 0.02)
    assert row.z_self == pytest.approx((0.9 - 0.2) / sd, abs=1e-3)
    assert (row.direction, row.tier, row.weight) == ("elevated", "T2", 0.7)
    assert (row.breach_0, row.breach_1, row.breach_2) == (1.0, 7 / 30, 7 / 90)


def test_short_history_says_nothing(spark):
    rows = [("p", "leave", "U1", 0.2, o, 0) for o in range(90, 99)] + [
        ("p", "leave", "U1", 0.9, 0, 0)]
    _, profile = screen(signals(spark, rows), AS_OF, CFG)
    assert profile.first().base_n == 9
    assert deviation.deviations(profile, CFG).count() == 0


def test_daily_mean_last_unit_and_retention(spark):
    rows = [("p", "leave", "U1", 0.2, 5, 3), ("p", "leave", "U2", 0.6, 5, 9),
            ("p", "training", "U1", 1.0, 7, 0), ("p", "leave", "U1", 0.3, 400, 0)]
    daily = features.daily_series(signals(spark, rows))
    got = {(r.domain, (AS_OF - r.day).days): (round(r.value, 9), r.unit_id, r.rows)
           for r in daily.collect()}
    assert got[("leave", 5)] == (0.4, "U2", 2) and got[("training", 7)][1] == "U2"
    assert features.retained(daily, AS_OF, CFG).count() == 2
    assert features.membership(daily).first().domains == ["leave", "training"]


def test_unit_baseline_counts_people_not_rows(spark):
    rows = [(f"p{i}", "leave", "U1", 0.2, 0, 0) for i in range(10)]
    rows += [("loud", "leave", "U1", 1.0, o, h) for o in range(7) for h in range(3)]
    _, profile = screen(signals(spark, rows), AS_OF, CFG)
    row = features.unit_baseline(profile, CFG).first()
    assert row.unit_n == 11 and row.unit_mean == pytest.approx(3 / 11)


def test_fraction_splits_by_direction(spark):
    rows = []
    for i in range(10):
        base = [(f"p{i}", "leave", "U1", 0.5, o, 0) for o in range(90, 120)]
        rows += base + [(f"p{i}", "leave", "U1", 0.9 if i < 5 else 0.1, o, 0) for o in range(7)]
    _, profile = screen(signals(spark, rows), AS_OF, CFG)
    devs = deviation.deviations(profile, CFG)
    assert deviation.unit_fractions(devs, profile).first().unit_fraction == 0.5
    assert deviation.cleared(profile, devs).count() == 0


def test_rolling_window_matches_a_plain_one(spark):
    rng = random.Random(1)
    rows = [("p", "leave", "U1", rng.random(), o, 0) for o in range(60) if rng.random() < 0.7]
    got = {(AS_OF - r.day).days: (r.n, r.mean) for r in features.rolling_stats(
        features.daily_series(signals(spark, rows)), 7, 3).collect()}
    for _, _, _, _, offset, _ in rows:
        inside = [r[3] for r in rows if offset + 3 <= r[4] <= offset + 9]
        n, mean = got[offset]
        assert n == len(inside)
        assert mean == (pytest.approx(statistics.fmean(inside)) if inside else None)


@pytest.mark.parametrize("pattern", ["1111000110", "0000000000", "1111111111", "101"])
def test_rhythm(spark, pattern):
    rows = [("p", "duty_roster", "U1", float(c), len(pattern) - i, 0)
            for i, c in enumerate(pattern)]
    daily = features.daily_series(signals(spark, rows))
    row = rhythm.rhythm(daily, AS_OF, CFG, "duty_roster").first()
    on = [len(x) for x in pattern.replace("0", " ").split()]
    off = [len(x) for x in pattern.replace("1", " ").split()]
    if len(pattern) < 4 or not on:
        assert (row.longest_run, row.regularity) == (0, 0.0)
        return
    rest = sum(x >= 2 for x in off) / len(off) if off else 0.0
    cv = min(1, statistics.pstdev(on) / statistics.fmean(on)) if len(on) > 1 else 1.0
    assert row.longest_run == max(on)
    assert row.regularity == round((1 - cv) * (0.5 + 0.5 * rest), 4)


def test_median_of_large_and_small_groups(spark):
    rng = random.Random(3)
    rows = [("hot", round(rng.gauss(0, 5), 1)) for _ in range(5001)]
    rows += [("even", float(v)) for v in (4, 1, 3, 2)] + [("far", 1e9), ("far", -1e9), ("far", 7.0)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").withColumns(
        {"lo": F.lit(-1.0), "hi": F.lit(1.0)})
    got = {r.k: (r.n, r.median) for r in grouped_median(df, ["k"], "v", "lo", "hi").collect()}
    for k in ("hot", "even", "far"):
        values = [v for name, v in rows if name == k]
        assert got[k] == (len(values), pytest.approx(statistics.median(values)))


def test_one_person_with_a_third_of_all_rows(spark):
    """A hot person changes nothing for the others, and their own result is the whole truth."""
    people = [r for i in range(6) for r in spike(f"p{i}")]
    hot = [("hot", "workload", "U1", v, o, h) for _, _, _, v, o, _ in spike("hot")
           for h in range(3)]
    _, alone = screen(signals(spark, people), AS_OF, CFG)
    _, mixed = screen(signals(spark, people + hot), AS_OF, CFG)
    keep = ["pid", "base_n", "base_mean", "base_stdev", "breach_1"]
    a = {r.pid: r for r in alone.select(*keep).collect()}
    b = {r.pid: r for r in mixed.select(*keep).collect()}
    for p, row in a.items():
        assert tuple(b[p])[1:] == pytest.approx(tuple(row)[1:])
    assert b["hot"].base_n == 180 and b["hot"].base_mean == pytest.approx(a["p0"].base_mean)


def test_plan_shape(spark):
    """One scan of the events with pushed columns, and pre-aggregation before the first shuffle."""
    daily = features.daily_series(features.in_history(
        T.event_signals(spark, SMALL), T.EVENTS_AS_OF, 30))
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "props" not in plan
    first = plan.rindex("Exchange")
    assert "partial_sum" in plan[first:]


def test_kept_and_lazy_runs_agree(spark):
    args = (T.event_signals(spark, SMALL), T.consent_states(spark, SMALL), T.EVENTS_AS_OF,
            T.EVENTS_CONFIG)
    a = nightly(*args, keep=True, detail=False).verdicts.select("pid", "decision", "reason")
    b = nightly(*args, keep=False, detail=False).verdicts.select("pid", "decision", "reason")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_stage_log_counts_what_was_written(spark):
    from vigilframe.operators.views import run_summary
    from vigilframe.plans.nightly import StageLog, all_cases

    log = StageLog()
    night = nightly(T.event_signals(spark, SMALL), T.consent_states(spark, SMALL), T.EVENTS_AS_OF,
                    T.EVENTS_CONFIG, log=log, detail=False)
    stages = log.table(spark)
    got = {r.name: r for r in stages.collect()}
    assert got["profile"].rows_out == night.profile.count()
    assert (got["deviations"].rows_in, got["deviations"].rows_out) == (
        night.profile.count(), night.deviations.count())
    text = run_summary(all_cases(night), "run", T.EVENTS_AS_OF, T.EVENTS_CONFIG, stages).first()[0]
    assert '"stages":[{"name":"deviations"' in text and '"run_id":"run"' in text


def test_config_is_checked():
    with pytest.raises(ValueError):
        Config(baseline_lag=30)
    with pytest.raises(ValueError):
        Config(persistence_weights=(0.5, 0.5, 0.5))


def test_one_key_with_most_rows_is_cut_into_stretches(spark):
    from pyspark.sql import functions as F

    from vigilframe.functions.ordered import lagged, running

    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("pid"),
        F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))
    out = running(rows, ["pid"], "seq", {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}, 64)
    out = lagged(out, ["pid"], "seq", "v", "before", 64).filter("pid = 'hot'").orderBy("seq").collect()
    total, last = 0, None
    for r in out:
        total += r.v
        assert (r.total, r.before) == (total, last)
        last = r.v
    assert len(out) == 4500 and max(r.top for r in out) == 6
