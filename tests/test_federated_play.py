"""Rounds of a campaign against a loop over dictionaries."""

import math

import pytest

from vigilframe.config import Config
from vigilframe.operators import federated

CFG = Config().but(clip_norm=0.5, min_participants=3, fed_epsilon_round=1.0, fed_epsilon_total=2.0)


def reports(spark, rounds):
    schema = "unit_id STRING, pos INT, value DOUBLE, n_examples BIGINT"
    return [spark.createDataFrame([(u, i, x, n) for u, (v, n) in told.items() for i, x in enumerate(v)], schema)
            for told in rounds]


def by_hand(base, rounds, spent=0.0):
    out = []
    for told in rounds:
        reason = "too few units" if len(told) < 3 else "budget exhausted" if spent + 1 > 2 else ""
        if not reason:
            step, whole = [0.0] * len(base), sum(n for _, n in told.values())
            for v, n in told.values():
                delta = [a - b for a, b in zip(v, base)]
                norm = math.sqrt(sum(x * x for x in delta))
                step = [s + x * min(1, 0.5 / norm if norm else 1) * n / whole for s, x in zip(step, delta)]
            base, spent = [b + s for b, s in zip(base, step)], spent + 1
        out.append((list(base), reason, spent))
    return out


ROUNDS = [{"a": ([1.0, 2.0], 4), "b": ([0.1, 0.1], 1), "c": ([0.0, -3.0], 2)}, {"a": ([5.0, 5.0], 9), "b": ([1.0, 1.0], 9)},
          {"a": ([0.3, 0.2], 4), "c": ([0.2, 0.2], 1), "d": ([9.0, 0.0], 2)}, {u: ([1.0, 1.0], 1) for u in "abcd"}]


def test_rounds_follow_the_vector_they_left(spark):
    base = spark.createDataFrame([(0, 0.25), (1, 0.5)], "pos INT, value DOUBLE")
    played = federated.play("x", base, reports(spark, ROUNDS), CFG)
    want = by_hand([0.25, 0.5], ROUNDS)
    for vector, (values, _, _) in zip(played.vectors, want):
        assert [r.value for r in vector.orderBy("pos").collect()] == pytest.approx(values)
    rows = played.table(spark).orderBy("round").collect()
    assert [(r.reason, r.spent, r.completed) for r in rows] == [(reason, spent, not reason) for _, reason, spent in want]
    assert rows[0].participants == ["a", "b", "c"] and rows[1].units == 2 and rows[0].clipped == 2


def test_earlier_spending_counts_and_noise_is_fixed(spark):
    base = spark.createDataFrame([(0, 0.25), (1, 0.5)], "pos INT, value DOUBLE")
    told = reports(spark, [ROUNDS[0], ROUNDS[2]])
    assert [r[8] for r in federated.play("x", base, told, CFG, spent=1.0).history] == ["", "budget exhausted"]

    def drawn(secret):
        return [r.value for r in federated.play("x", base, told, CFG, secret=secret).vectors[-1].orderBy("pos").collect()]

    plain = [r.value for r in federated.play("x", base, told, CFG).vectors[-1].orderBy("pos").collect()]
    assert drawn("k") == drawn("k") != drawn("other") and drawn("k") != plain
