"""Golden gate values, verdict order and the invariants of the decision layer."""

import pytest
from builders import CFG, case, deviation, frame

from vigilframe.operators.gates import evaluate
from vigilframe.operators.verdicts import acute_items, decide


def values(spark, column, *rows):
    out = evaluate(frame(spark, *rows), CFG).select("pid", column).collect()
    return {r.pid: r[column] for r in out}


def test_evidence(spark):
    got = values(
        spark, "evidence",
        case("a", *[deviation(d) for d in ("self_report", "leave", "workload")]),
        case("b", *[deviation(d) for d in ("leave", "workload", "duty_roster", "transfer")]),
        case("c", *[deviation(d) for d in ("leave", "workload", "transfer")]),
        case("d", deviation("leave")), case("e", deviation("transfer")))
    assert {k: round(v, 3) for k, v in got.items()} == {
        "a": 1.0, "b": 0.8, "c": 0.675, "d": 0.246, "e": 0.183}


def test_consistency(spark):
    three = ("leave", "workload", "duty_roster")
    got = values(
        spark, "consistency",
        case("clean", *[deviation(d) for d in three]),
        case("surge", *[deviation(d, fraction=0.5)
                        for d in ("self_report", "leave", "workload", "duty_roster")]),
        case("lone", deviation("leave", missing=0.3)), case("none"))
    assert round(got["clean"], 3) == 1.0
    assert got["lone"] == 0.0 and got["none"] == 0.0
    assert 0 < got["surge"] < 1


def test_unshared_explanations_discount_support(spark):
    got = values(
        spark, "consistency",
        case("shared", *[deviation(d, fraction=0.5) for d in ("leave", "workload", "duty_roster")]),
        case("leaky", deviation("deployment"),
             *[deviation(d, fraction=0.5) for d in ("leave", "workload", "duty_roster")]))
    shared = 1.4 / (1.4 + 0.7)
    assert got["shared"] == pytest.approx(shared)
    lone = 2.1 * 0.3 / 2.1
    others = (1.4 + 0.7) / (2.1 + 0.7)
    assert got["leaky"] == pytest.approx((lone + 3 * others) / 4)


def test_persistence(spark):
    got = values(
        spark, "persistence",
        case("a", deviation("leave")), case("b", deviation("leave", breach=(1.0, 1.0, 0.2))),
        case("c", deviation("leave", breach=(1.0, 7 / 30, 7 / 90))),
        case("absent", deviation("leave", breach=(1.0, 1.0, 0.9)),
             deviation("self_report", breach=(1.0, None, None))),
        case("zero", deviation("leave", breach=(1.0, 1.0, 0.9)),
             deviation("self_report", breach=(1.0, 0.0, 0.0))))
    assert [round(got[k], 3) for k in "abc"] == [0.965, 0.72, 0.332]
    assert got["absent"] == pytest.approx(got["a"])  # an absent window is not a zero
    assert got["zero"] < got["absent"]


def test_actionability(spark):
    dev = deviation("leave")
    got = values(
        spark, "actionability", case("ok", dev), case("full", dev, capacity=False),
        case("dup", dev, active=["WLF-LEAVE"]), case("silent", dev, contact=False),
        case("gone", dev, status="REVOKED"), case("quiet", dev, suppressed=["leave"]))
    assert got == {"ok": 1.0, "full": 0.75, "dup": 0.0, "silent": 0.0, "gone": 0.0, "quiet": 0.0}


def test_precedence(spark):
    strong = [deviation(d) for d in ("self_report", "leave", "workload")]
    brief = [deviation(d, breach=(1.0, 0.1, 0.0)) for d in ("self_report", "leave", "workload")]
    rows = frame(
        spark, case("go", *strong), case("brief", *brief), case("thin", deviation("leave")),
        case("closed", *strong, scope=[]), case("nocontact", *strong, contact=False),
        case("acute", deviation("leave", breach=(0.0, 0.0, 0.0)), acute=["item_9"]),
        case("clinician", deviation("leave"), clinician=True))
    got = {r.pid: (r.decision, r.reason) for r in decide(rows, CFG).collect()}
    assert got["go"] == ("ESCALATE", "all four gates passed")
    assert got["brief"] == ("MONITOR", "not yet sustained")
    assert got["thin"] == ("MONITOR", "insufficient or confounded evidence")
    assert got["closed"] == ("NO_FLAG", "no consent basis for any deviating domain")
    assert got["nocontact"] == ("NO_FLAG", "no available or non-duplicate welfare action")
    assert got["acute"] == ("IMMEDIATE_ESCALATE", "safety override: acute item(s) item_9")
    assert got["clinician"] == ("IMMEDIATE_ESCALATE", "safety override: clinician concern raised")
    frozen = {r.pid: r.decision for r in decide(rows, CFG, True).collect()}
    assert frozen["go"] == "MONITOR" and frozen["acute"] == "IMMEDIATE_ESCALATE"


def test_recommendations_and_counterfactuals(spark):
    rows = frame(
        spark, case("acute", deviation("leave"), acute=["item_9"]),
        case("thin", deviation("leave", breach=(1.0, 0.2, 0.1), fraction=0.5)))
    got = {r.pid: r for r in decide(rows, CFG).collect()}
    assert got["acute"].recommended == ["MH-URGENT"] and got["acute"].mind_change == []
    order = [(m.recoverable, round(m.required - m.current, 4)) for m in got["thin"].mind_change]
    assert order == sorted(order, key=lambda x: (not x[0], x[1]))
    assert any(t == "outlasts(unit_op_tempo,leave,0.70)" for m in got["thin"].mind_change
               for t in m.would_change_if)


def test_cohort_files(spark, tmp_path):
    """JSON cohorts decide like hand-built rows, and prose fields never enter the schema."""
    import json

    from vigilframe.sources.documents import cohort_cases, cohort_names, cohorts

    def person(pid, domains, fraction=None, breach=(1.0, 1.0, 0.9), **more):
        return {
            "pid": pid, "unit_id": "unit-A",
            "consent": {"scope": list(CFG.domains), "welfare_contact": True, "status": "ACTIVE"},
            "unit": {"unit_id": "unit-A", "cohort_size": 120,
                     "cohort_deviating_fraction": {d: fraction for d in domains} if fraction else {},
                     "welfare_capacity_available": True},
            "deviations": [{"domain": d, "z_self": 2.6, "z_unit": 2.1, "direction": "elevated",
                            "windows_breached": 3, "missing_fraction": 0.0,
                            "daily_breach": dict(zip(("7", "30", "90"), breach))}
                           for d in domains],
            "expected": "IGNORED", "note": "IGNORED", **more}

    trio = ["self_report", "leave", "workload"]
    files = {"first": [person("go", trio), person("surged", trio, 0.5)],
             "second": [person("brief", trio, breach=(1.0, 0.1, 0.0)),
                        person("acute", ["leave"], acute_items=["item_9"])]}
    for name, people in files.items():
        (tmp_path / f"cohort_{name}.json").write_text(json.dumps(
            {"cohort": name, "description": "d", "as_of": "2026-09-05", "personnel": people},
            indent=1))
    path = str(tmp_path / "cohort_*.json")
    people = cohorts(spark, path)
    assert "expected" not in people.columns and "note" not in people.columns
    out = {r.pid: r for r in decide(cohort_cases(people, CFG), CFG).collect()}
    assert {p: r.decision for p, r in out.items()} == {
        "go": "ESCALATE", "surged": "MONITOR", "brief": "MONITOR", "acute": "IMMEDIATE_ESCALATE"}
    assert out["surged"].consistency == pytest.approx(25 / 36)
    assert [r.cohort for r in cohort_names(spark, path).collect()] == ["first", "second"]


@pytest.mark.parametrize("extra", ["workload", "transfer", "self_report"])
def test_more_agreement_never_lowers_evidence(spark, extra):
    base = [deviation("leave"), deviation("duty_roster")]
    got = values(spark, "evidence", case("a", *base), case("b", *base, deviation(extra)))
    assert got["b"] >= got["a"]


@pytest.mark.parametrize("fraction", [0.4, 0.6, 1.0])
def test_a_confounder_never_raises_consistency(spark, fraction):
    names = ("leave", "workload", "duty_roster")
    got = values(spark, "consistency", case("a", *[deviation(d) for d in names]),
                 case("b", *[deviation(d, fraction=fraction) for d in names]),
                 case("c", deviation("leave", fraction=fraction),
                      *[deviation(d) for d in names[1:]]))
    assert got["b"] <= got["a"] and got["c"] <= got["a"]


def test_gates_stay_in_range_and_single_domain_never_escalates(spark):
    rows = [case(d, deviation(d)) for d in CFG.domains]
    out = decide(frame(spark, *rows), CFG, detail=False).collect()
    for r in out:
        assert all(0 <= r[g] <= 1 for g in ("evidence", "consistency", "persistence",
                                            "actionability", "composite"))
        assert r.decision != "ESCALATE"


def test_acute_items(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(
        [("PHQ9", {"item_9": 1}), ("PHQ9", {"item_9": 0}), ("GAD7", {"item_9": 3}),
         ("OTHER", {"item_9": 3}), ("PHQ9", {})], "i STRING, m MAP<STRING,INT>")
    got = [r.a for r in rows.select(acute_items(F.col("i"), F.col("m"), CFG).alias("a")).collect()]
    assert got == [["item_9"], [], [], [], []]
