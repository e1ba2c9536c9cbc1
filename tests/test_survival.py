"""The hazard: censoring by hand, fitted and composed, saved with its own digest, absent without harm."""

import math
import random
from datetime import date, timedelta

import pytest

from vigilframe.config import HORIZONS
from vigilframe.operators import models, survival

ENTRY = date(2024, 1, 1)


def test_follow_up_and_intervals_by_hand(spark):
    rng = random.Random(5)
    people = [(f"p{i}", ENTRY, ENTRY + timedelta(days=rng.randint(-2, 130))) for i in range(60)]
    events = [(rng.choice(people)[0], ENTRY + timedelta(days=rng.randint(-20, 140))) for _ in range(150)]
    frame = spark.createDataFrame(people, "pid STRING, entry DATE, left DATE")
    told = spark.createDataFrame(events + events[:10], "pid STRING, on DATE")
    followed = survival.follow_up(frame, told, 90)
    want, table = {}, {}
    for pid, entry, left in people:
        if left < entry:
            continue
        days = [(on - entry).days for who, on in events if who == pid and entry <= on <= left]
        first = min(days, default=None)
        event = first is not None and first < 90
        stay = first if event else min((left - entry).days, 90)
        want[pid] = (stay, event)
        for k in range(stay // 7 + event):
            at_risk, had = table.get(k, (0, 0))
            table[k] = (at_risk + 1, had + (event and k == stay // 7))
    assert {r.pid: (r.days, r.event) for r in followed.collect()} == want
    left = 1.0
    for r in survival.life_table(survival.person_intervals(followed, 7)).orderBy("interval").collect():
        at_risk, had = table.pop(r.interval)
        left *= 1 - had / at_risk
        assert (r.at_risk, r.events) == (at_risk, had) and r.survival == pytest.approx(left)
    assert not table
    assert survival.person_intervals(followed.limit(0), 7).count() == 0


def test_strata_and_composition(spark):
    rows = spark.createDataFrame([("a", 0)] * 30 + [("a", 1)] * 10 + [("b", 0)] * 8, "kind STRING, label INT")
    fitted = {r.kind: r.hazard for r in survival.hazard_by(rows, ["kind"]).collect()}
    assert fitted == {"a": 0.25, "b": 0.0}
    people = spark.createDataFrame([("x", 0.25), ("y", 0.0), ("z", None)], "pid STRING, hazard DOUBLE")
    got = {r.pid: r for r in survival.composed(people).collect()}
    assert got["x"].risk_30d == pytest.approx(round(1 - 0.75 ** (30 / 7), 4))
    assert got["x"].median_days == round(7 * math.log(0.5) / math.log(0.75)) and got["x"].soonest == 30
    assert got["y"].risk_90d < 0.01 and got["y"].median_days is None and got["y"].horizon_status == "ok"
    z = got["z"]
    assert z.horizon_status == "unavailable" and z.median_days is None and z.phrase == survival.PHRASE_UNAVAILABLE
    assert all(z[f"risk_{d}d"] is None for d in HORIZONS)


def test_boosted_hazard_is_fitted_saved_and_tampered(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        strain = rng.random()
        chance = 0.45 if strain > 0.6 else 0.01
        days, event = 90, False
        for k in range(13):
            if rng.random() < chance:
                days, event = 7 * k + 3, True
                break
        rows.append((f"p{i}", strain, rng.random(), days, event))
    people = spark.createDataFrame(rows, "pid STRING, strain DOUBLE, noise DOUBLE, days INT, event BOOLEAN")
    intervals = survival.person_intervals(people, 7)
    model = survival.fit(intervals, ["strain", "noise"], "hazard-t", iterations=8)
    out = {r.pid: r for r in survival.estimate(model, people.select("pid", "strain", "noise")).collect()}
    high = [out[p].hazard for p, strain, *_ in rows if strain > 0.65]
    low = [out[p].hazard for p, strain, *_ in rows if strain < 0.55]
    assert sum(high) / len(high) > 0.2 > 0.08 > sum(low) / len(low)
    assert {r.horizon_status for r in out.values()} == {"ok"} and {r.model_version for r in out.values()} == {"hazard-t"}
    path = str(tmp_path / "hazard")
    mark = models.save(model, spark, path)
    again = models.load(spark, path)
    same = {r.pid: r.hazard for r in survival.estimate(again, people.select("pid", "strain", "noise")).collect()}
    assert mark and same == {p: r.hazard for p, r in out.items()}
    spark.range(3).write.mode("append").parquet(f"{path}/booster/stages")
    assert models.load(spark, path) is None
    gone = survival.estimate(None, people.select("pid", "strain", "noise")).collect()
    assert {(r.horizon_status, r.model_version, r.hazard) for r in gone} == {("unavailable", "unavailable", None)}
    assert survival.fit(intervals.where("label = 0"), ["strain", "noise"], "none") is None


def drawn_rows(spark, n=600):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        strain, noise, last = rng.random(), rng.random(), rng.randint(0, 11)
        event = int(rng.random() < strain)
        rows += [(f"p{i}", strain, noise, int(event and k == last)) for k in range(last + 1)]
    return rows, spark.createDataFrame(rows, "pid STRING, strain DOUBLE, noise DOUBLE, label INT")


def test_interval_rows_are_made_once(spark):
    rows, frame = drawn_rows(spark, 100)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    assert survival.fit(frame.mapInArrow(counted, frame.schema), ["strain", "noise"], "once", iterations=2)
    assert made.value == len(rows)


def test_training_parts_are_even_and_do_not_follow_the_files(spark, monkeypatch):
    slots = spark.sparkContext.defaultParallelism
    few, many = models.LEAST_ROWS, models.MOST_ROWS
    assert [models.parts_for(n, 12) for n in (0, 1, few + 1, 12 * many, 12 * many + 1)] == [1, 1, 2, 12, 24]
    rows, frame = drawn_rows(spark)
    monkeypatch.setattr(models, "LEAST_ROWS", 10)
    parts = models.dealt(frame.repartition(slots + 1), ["strain", "noise"]).rdd.glom().map(len).collect()
    assert len(parts) == slots and sum(parts) == len(rows) and max(parts) < 2 * len(rows) / slots
    scores = []
    for laid in (frame.coalesce(1), frame.repartition(slots + 1, "noise"), frame.orderBy("noise")):
        model = survival.fit(laid, ["strain", "noise"], "same", iterations=3)
        scores.append({r.pid: r.hazard for r in survival.estimate(model, frame.dropDuplicates(["pid"])).collect()})
    assert scores[0] == scores[1] == scores[2] and len(set(scores[0].values())) > 2
