"""Release, ledger, consent, alerts and feedback against brute force."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vigilframe.config import DOMAINS, Config
from vigilframe.operators import alerts, consent, feedback, ledger, models, release
from vigilframe.operators import evaluation as ev

CFG = Config()
AS_OF = date(2026, 9, 5)


def test_small_cells_keep_nothing(spark):
    rows = spark.createDataFrame([("U1", "a", 1.0)] * 4 + [("U1", "b", 0.25)] * 5,
                                 "unit_id STRING, label STRING, value DOUBLE")
    cells = release.cells(rows, ["unit_id", "label"], CFG)
    out = {r.label: r for r in release.redacted(release.exact(cells)).collect()}
    assert (out["a"].n, out["a"].value, out["a"].suppressed) == (None, None, True)
    assert (out["b"].n, out["b"].value) == (5, 0.25)


def test_noise_is_the_same_answer_to_the_same_question(spark):
    rows = spark.createDataFrame([(f"U{i}", "a", 0.5) for i in range(40) for _ in range(20)],
                                 "unit_id STRING, label STRING, value DOUBLE")
    cells = release.cells(rows, ["unit_id", "label"], CFG)

    def draw(day, secret="s"):
        out = release.noised(cells, ["unit_id", "label"], day, secret, CFG)
        return {r.unit_id: (r.n, r.value) for r in out.collect()}

    first = draw(AS_OF)
    assert first == draw(AS_OF) and first != draw(date(2026, 9, 6)) and first != draw(AS_OF, "t")
    assert all(n >= CFG.k_min for n, _ in first.values())
    assert len({v for _, v in first.values()}) > 30
    assert abs(sum(v for _, v in first.values()) / 40 - 0.5) < 0.2


def test_budget_stops_in_label_order(spark):
    rows = spark.createDataFrame([("U1", f"l{i}", 0.5) for i in range(10) for _ in range(5)],
                                 "unit_id STRING, label STRING, value DOUBLE")
    cells = release.cells(rows, ["unit_id", "label"], CFG)
    kept = release.within_budget(cells, ["unit_id"], "label", CFG.but(epsilon_total=3.0))
    assert sorted(r.label for r in kept.collect()) == ["l0", "l1", "l2"]


def entries(spark, n):
    return spark.range(n).select(
        F.col("id").alias("seq"), F.lit("2026-09-05T00:00:00").alias("at"), F.lit("a:1").alias("actor"),
        F.lit("x").alias("action"), F.concat(F.lit("p"), F.col("id") % 7).alias("subject_pid"),
        F.lit("U").alias("unit_id"), F.lit("w").alias("purpose"),
        F.create_map(F.lit("k"), F.col("id").cast("string")).alias("detail"))


def test_ledger_chain(spark):
    import hashlib
    import json

    sealed = ledger.seal(entries(spark, 2500)).persist()
    rows = {r.seq: r for r in sealed.collect()}
    previous = ledger.GENESIS
    for seq in range(1024):
        r = rows[seq]
        body = {"seq": seq, "at": r.at, "actor": r.actor, "action": r.action,
                "subject_pid": r.subject_pid, "unit_id": r.unit_id, "purpose": r.purpose,
                "detail": {"k": str(seq)}, "prev_hash": previous}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        assert r.prev_hash == previous
        previous = hashlib.sha256(text.encode()).hexdigest()
        assert r.entry_hash == previous
    assert rows[1024].prev_hash == ledger.GENESIS
    assert ledger.first_break(sealed).first().verified
    changed = sealed.withColumn("action", F.when(F.col("seq") == 1500, "y").otherwise(
        F.col("action")))
    assert ledger.first_break(changed).first()[1:] == (1500, "content does not match its hash")
    heads = ledger.heads(sealed).persist()
    assert ledger.first_break(sealed, heads).first().verified
    lost = ledger.first_break(sealed.filter("segment <> 1"), heads).first()
    assert lost[1:] == (1024, "segment missing")
    forged = ledger.seal(entries(spark, 2500).withColumn("purpose", F.lit("another"))).filter("segment = 1")
    swapped = sealed.filter("segment <> 1").unionByName(forged)
    assert ledger.first_break(swapped).first().verified  # consistent in itself
    assert ledger.first_break(swapped, heads).first()[1:] == (
        1024, "segment does not match its sealed head")
    assert ledger.root(heads).first() != ledger.root(ledger.heads(swapped)).first()
    gone = ledger.first_break(sealed.filter("seq <> 77")).first()
    assert gone.seq == 78 and gone.reason == "sequence gap"
    relinked = sealed.withColumn("prev_hash", F.when(F.col("seq") == 9, "0" * 64).otherwise(
        F.col("prev_hash")))
    assert ledger.first_break(relinked).first()[1:] == (9, "prev_hash does not match the entry before")
    heads = sorted(ledger.heads(sealed).collect())
    assert [h.rows for h in heads] == [1024, 1024, 452]


def fold_plainly(events):
    state = {}
    for pid, _, kind, domains, contact in sorted(events, key=lambda e: e[1]):
        scope, ok, _ = state.get(pid, (set(), False, ""))
        if kind == "enrol":
            scope, ok = set(domains), contact
        elif kind == "narrow":
            scope = scope - set(domains)
        elif kind == "widen":
            scope = scope | set(domains)
        elif kind == "set_contact":
            ok = contact
        else:
            scope, ok = set(), False
        status = ("REVOKED" if kind == "revoke" else "NOT_ENROLLED" if not scope else
                  "ACTIVE" if scope == set(DOMAINS) else "PARTIAL")
        state[pid] = (scope, ok, status)
    return state


def test_consent_fold(spark):
    rng = random.Random(5)
    kinds = ("enrol", "narrow", "widen", "set_contact", "revoke", "complete")
    events = [(f"p{rng.randrange(12)}", i, rng.choice(kinds),
               rng.sample(DOMAINS, rng.randrange(0, 10)), rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(
        events, "pid STRING, seq INT, kind STRING, domains ARRAY<STRING>, contact BOOLEAN")
    got = {r.pid: (set(r.scope), r.welfare_contact, r.status)
           for r in consent.fold(df, DOMAINS).collect()}
    assert got == fold_plainly(events)


def test_alert_queue(spark):
    rng = random.Random(9)
    log = [(f"p{rng.randrange(5)}", i, rng.choice(("enqueue", "deliver", "deliver", "enqueue",
                                                   "cancel"))) for i in range(500)]
    waiting, final = {}, set()
    for pid, seq, kind in log:
        queue = waiting.setdefault(pid, [])
        if kind == "enqueue":
            queue.append(seq)
        elif kind == "cancel":
            queue.clear()
        elif queue:
            final.add((pid, queue.pop(0), seq))
    final |= {(p, s, None) for p, q in waiting.items() for s in q}
    df = spark.createDataFrame(log, "pid STRING, seq BIGINT, kind STRING")
    for limit in (1 << 20, 37, 3):
        got = {(r.pid, r.seq, r.delivered_seq) for r in alerts.replay(df, limit).collect()}
        assert got == final


def test_state_log_across_stretches(spark):
    from vigilframe.config import LEGAL_STATES
    from vigilframe.operators.verdicts import illegal_transitions

    rng = random.Random(8)
    log = [(f"p{rng.randrange(3)}", i, rng.choice(list(LEGAL_STATES))) for i in range(200)]
    last, want = {}, set()
    for pid, seq, state in log:
        if pid in last and state not in LEGAL_STATES[last[pid]]:
            want.add((pid, seq, last[pid], state))
        last[pid] = state
    df = spark.createDataFrame(log, "pid STRING, seq BIGINT, state STRING")
    for limit in (1 << 20, 7):
        assert {tuple(r) for r in illegal_transitions(df, limit).collect()} == want


def test_sittings_across_stretches(spark):
    from vigilframe.operators.voice import sessions_by_gap

    hour = 3_600_000
    rng = random.Random(6)
    frames = sorted({(f"p{rng.randrange(2)}", rng.randrange(20 * 24) * hour) for _ in range(120)})
    want, last, number = set(), {}, {}
    for pid, at in frames:
        if pid not in last or at - last[pid] > 12 * hour:
            number[pid] = number.get(pid, 0) + 1
        last[pid] = at
        want.add((pid, at, number[pid]))
    df = spark.createDataFrame(frames, "pid STRING, at_ms BIGINT")
    for limit in (1 << 20, 5):
        got = sessions_by_gap(df, 12 * hour, limit).select("pid", "at_ms", "sitting").collect()
        assert {tuple(r) for r in got} == want


def test_alerts_wait_for_the_console(spark):
    rows = spark.createDataFrame(
        [("p", "U", "ESCALATE", "r", 0.5, ["WLF-REST"], True), ("q", "U", "MONITOR", "r", 0.1, [], False)],
        "pid STRING, unit_id STRING, decision STRING, reason STRING, composite DOUBLE, "
        "recommended ARRAY<STRING>, named BOOLEAN")
    night = alerts.enqueue(rows, datetime(2026, 9, 5, 2, 0)).collect()
    noon = alerts.enqueue(rows, datetime(2026, 9, 5, 12, 0)).first()
    assert len(night) == 1 and night[0].deliver_after.hour == 7 and noon.deliver_after.hour == 12
    assert alerts.shadow_log(rows).count() == 1


def test_prior_state(spark):
    rng = random.Random(2)
    history = [(f"p{rng.randrange(4)}", date(2020, 1 + rng.randrange(12), 1 + rng.randrange(28)), i,
                f"v{i}") for i in range(200)]
    events = [(f"p{rng.randrange(5)}", date(2020, 1 + rng.randrange(12), 1 + rng.randrange(28)), i)
              for i in range(100)]
    out = feedback.prior_state(
        spark.createDataFrame(events, "pid STRING, at DATE, n INT"),
        spark.createDataFrame(history, "pid STRING, at DATE, seq INT, v STRING"), ["v"])
    got = {r.n: r.prior_v for r in out.collect()}
    for pid, at, n in events:
        before = [h for h in history if h[0] == pid and h[1] < at]
        assert got[n] == (max(before, key=lambda h: (h[1], h[2]))[3] if before else None)


def test_proposals_point_one_way(spark):
    def report(good, bad):
        closes = spark.createDataFrame([("x", "supported")] * good + [("y", "not_supported")] * bad,
                                       "pid STRING, outcome STRING")
        routes = spark.createDataFrame([], "pid STRING, route STRING")
        return feedback.weekly_report(closes, routes)

    def surfaced(missed, named):
        rows = [("monitored", "evidence")] * missed + [("escalated", "")] * named
        df = spark.createDataFrame(rows, "prior_verdict STRING, blocking_gate STRING").withColumn(
            "surfaced_on", F.lit(AS_OF))
        return feedback.surfaced_report(df)

    tight = feedback.propose(report(10, 12), surfaced(10, 10), CFG).collect()
    assert [(p.gate, p.proposed) for p in tight] == [("evidence", 0.70), ("consistency", 0.75)]
    loose = feedback.propose(report(20, 2), surfaced(10, 10), CFG).collect()
    assert [(p.gate, p.proposed, p.direction) for p in loose] == [("evidence", 0.60, "loosen")]
    assert feedback.propose(report(20, 2), surfaced(2, 10), CFG).count() == 0
    assert feedback.propose(report(3, 3), surfaced(10, 10), CFG).count() == 0


def test_stability(spark):
    def psi(a, b):
        rows = [("baseline", float(x)) for x in a] + [("current", float(x)) for x in b]
        df = spark.createDataFrame(rows, "side STRING, score DOUBLE")
        return feedback.stability(df, CFG).first()

    uniform = [i / 100 for i in range(100)]
    assert psi(uniform, uniform).psi == 0.0
    assert psi(uniform, [min(1.0, u + 0.4) for u in uniform]).status == "frozen"
    assert psi(uniform, [0.05] * 100).status == "frozen"
    assert psi(uniform, []).psi == 0.0


def test_ranking_metrics(spark):
    rng = random.Random(4)
    rows = [(f"p{i}", round(rng.random(), 2), int(rng.random() < 0.3)) for i in range(300)]
    df = spark.createDataFrame(rows, "pid STRING, score DOUBLE, label INT")
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert ev.auroc(df).first().auroc == pytest.approx(want)
    assert ev.auroc(df.filter("label = 1")).first().auroc == 0.5
    only = spark.createDataFrame([("a", 0.9, 1), ("b", 0.8, 1), ("c", 0.7, 0)], df.schema)
    best = ev.select_threshold(ev.threshold_curve(only), 0.7).first()
    assert (best.threshold, best.precision, best.recall) == (0.80, 1.0, 1.0)


def test_model_round_trip_and_tampering(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("pid"), ((F.col("id") * 7919) % 100 / 100).alias("a"),
        ((F.col("id") * 104729) % 100 / 100).alias("b")).withColumn(
        "label", (F.col("a") > 0.8).cast("int"))
    model, held = models.fit(rows, ["a", "b"], "v1", iterations=5)
    assert ev.auroc(held.select("pid", F.col("risk_score").alias("score"), "label")
                    ).first().auroc > 0.95
    path = str(tmp_path / "m")
    models.save(model, spark, path)
    again = models.load(spark, path)
    assert again.version == "v1"
    a = models.score(model, rows).select("pid", "risk_score").orderBy("pid").collect()
    assert a == models.score(again, rows).select("pid", "risk_score").orderBy("pid").collect()
    assert max(again.importances, key=again.importances.get) == "a"
    (tmp_path / "m" / "booster" / "extra").write_text("x")
    assert models.load(spark, path) is None and models.load(spark, str(tmp_path / "no")) is None
    quiet = models.score(None, rows).first()
    assert (quiet.risk_score, quiet.risk_status) == (0.0, "unavailable")
