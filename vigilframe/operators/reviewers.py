"""Three reviewers argue each case.  None of them can move a number.

A reviewer is a function ``cfg -> Column`` giving one finding struct from a case row, so the whole
panel is one projection.  A new reviewer is one more entry of the panel.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import PLAYBOOK, PRECEDENTS, REVIEWERS, Config
from vigilframe.functions.scalar import fixed, let, percent, signed, strings
from vigilframe.operators.cases import consented
from vigilframe.operators.gates import detect
from vigilframe.operators.verdicts import decide

Reviewer = Callable[[Config], Column]
TOP = 3
# findings are codes with parameters; whoever shows them words them
FREEZE_UNHEARD = "no_counter_case:monitor_only"
FREEZE_DRIFT = "score_drift:monitor_only"


def prepared(cases: DataFrame, cfg: Config) -> DataFrame:
    """Make sure the hits and the consented deviations are on the row."""
    out = cases if "hits" in cases.columns else detect(cases, cfg)
    return out if "consented" in out.columns else out.withColumn("consented", consented())


def finding(narrative: Column, assessments: Column | None = None,
            confounders: Column | None = None, interventions: Column | None = None) -> Column:
    none = strings(())
    return F.struct(
        narrative.alias("narrative"),
        (assessments if assessments is not None else F.lit("")).alias("assessments"),
        (confounders if confounders is not None else none).alias("confounders_found"),
        (interventions if interventions is not None else none).alias("precedent_interventions"))


def _listed(entries: Column) -> Column:
    return F.array_join(entries, " / ")


# ------------------------------------------------------------------- risk advocate ---
def risk_advocate_finding(cfg: Config) -> Column:
    devs = F.col("consented")
    ranked = F.transform(
        F.array_sort(F.transform(devs, lambda d: F.struct(
            (-F.abs(d["z_self"])).alias("key"), d["domain"].alias("domain"), d.alias("d")))),
        lambda s: s["d"])

    def describe(d: Column) -> Column:
        return F.concat(d["domain"], F.lit(":"), d["direction"], F.lit(":z="), signed(d["z_self"], 1),
                        F.lit(":windows="), d["windows_breached"].cast("string"))

    count = F.size(devs)
    weight = (F.when(F.exists(devs, lambda d: d["tier"] == "T1"), F.lit(";told_by_the_person"))
              .when(count >= TOP, F.concat(F.lit(";together="), count.cast("string"))).otherwise(""))
    narrative = F.when(count == 0, F.lit("concern=none")).otherwise(F.concat(
        F.lit("concern="), F.array_join(F.transform(F.slice(ranked, 1, TOP), describe), ","), weight))
    stances = F.transform(ranked, lambda d: F.concat(
        d["domain"], F.lit("|"),
        F.when(F.abs(d["z_self"]) >= cfg.z_self, "supports").otherwise("insufficient"),
        F.lit("|z_self="), signed(d["z_self"], 2), F.lit(", z_unit="), signed(d["z_unit"], 2),
        F.lit(", tier "), d["tier"]))
    return finding(narrative, _listed(stances))


def risk_advocate(cases: DataFrame, cfg: Config) -> DataFrame:
    return _single(cases, cfg, risk_advocate_finding)


# ----------------------------------------------------------------- confounder check ---
def _reason(h: Column) -> Column:
    return F.concat(h["label"], F.lit(":mass="), fixed(h["mass"], 2), F.lit(": "), h["detail"])


def confounder_check_finding(cfg: Config) -> Column:
    hits, devs = F.col("hits"), F.col("consented")

    def reasons(domain: Column) -> Column:
        return F.array_join(F.transform(
            F.filter(hits, lambda h: h["domain"] == domain), _reason), "; ")

    domains = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["domain"])))
    clean = F.size(hits) == 0
    nothing = F.concat(F.lit("benign=none"), F.when(F.size(devs) < 2, F.lit(";single_domain")).otherwise(""))
    against = F.concat(
        F.lit("benign="),
        F.array_join(F.transform(domains, lambda d: F.concat(d, F.lit(": "), reasons(d))), " | "),
        F.when(F.exists(hits, lambda h: h["rule"] == "unit_op_tempo"), F.lit(";whole_unit")).otherwise(""),
        F.when(F.exists(hits, lambda h: h["rule"] == "data_gap"), F.concat(
            F.lit(";records_missing>"), percent(F.lit(cfg.data_gap_fraction)))).otherwise(""))
    stances = F.transform(devs, lambda d: F.when(
        F.exists(hits, lambda h: h["domain"] == d["domain"]),
        F.concat(d["domain"], F.lit("|contradicts|"), reasons(d["domain"]))
    ).otherwise(F.concat(d["domain"], F.lit("|supports|none"))))
    rules = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["rule"])))
    return finding(F.when(clean, nothing).otherwise(against), _listed(stances), rules)


def confounder_check(cases: DataFrame, cfg: Config) -> DataFrame:
    return _single(cases, cfg, confounder_check_finding)


# ------------------------------------------------------------------ welfare context ---
def ranked_precedents() -> Column:
    """Top closed cases by Jaccard overlap of driver tokens; ties keep the published order."""
    mine = F.array_distinct(F.flatten(F.transform("consented", lambda d: F.split(d["domain"], "_"))))
    entries = []
    for order, (code, drivers, action, outcome, note) in enumerate(PRECEDENTS):
        theirs = strings(sorted({t for d in drivers for t in d.split("_")}))
        score = F.when(F.size(mine) == 0, 0.0).otherwise(
            F.size(F.array_intersect(mine, theirs)) / F.size(F.array_union(mine, theirs)))
        entries.append(F.struct(
            (-score).alias("key"), F.lit(order).alias("position"), score.alias("score"),
            F.lit(code).alias("code"), F.lit(action).alias("action"),
            F.lit(outcome).alias("outcome"), F.lit(note).alias("note")))
    return F.slice(F.filter(F.array_sort(F.array(*entries)), lambda p: p["score"] > 0), 1, TOP)


def precedents(cases: DataFrame) -> DataFrame:
    return cases.withColumn("precedents", ranked_precedents())


def welfare_context_finding(cfg: Config) -> Column:
    return let(ranked_precedents(), _welfare_story)


def _welfare_story(matched: Column) -> Column:
    lines = F.transform(matched, lambda p: F.concat(
        p["code"], F.lit(":overlap="), percent(p["score"]), F.lit(":"), p["outcome"], F.lit(": "), p["note"]))
    cautions = F.transform(
        F.filter(matched, lambda p: p["outcome"].isin("not_supported", "already_known")),
        lambda p: F.concat(p["code"], F.lit(":"), p["outcome"]))
    story = F.concat(
        F.lit("precedents="), F.when(F.size(matched) > 0, F.array_join(lines, " | ")).otherwise("none"),
        F.lit(";strength="), F.col("cohort_size").cast("string"),
        F.lit(";capacity="), F.when(F.col("capacity"), "free").otherwise("used"),
        F.when(F.size("active_codes") > 0, F.concat(F.lit(";running="), F.array_join("active_codes", ","))).otherwise(""),
        F.when(F.size(cautions) > 0, F.concat(F.lit(";caution="), F.array_join(cautions, ","))).otherwise(""))
    empty = F.size("consented") == 0
    actions = F.transform(matched, lambda p: p["action"])
    return finding(
        F.when(empty, F.lit("precedents=none;no_domain")).otherwise(story),
        interventions=F.when(empty, strings(())).when(F.size(actions) > 0, actions)
        .otherwise(strings([PLAYBOOK[0][0]])))


def welfare_context(cases: DataFrame, cfg: Config | None = None) -> DataFrame:
    return _single(cases, cfg or Config(), welfare_context_finding)


# -------------------------------------------------------------------------- the panel ---
def _single(cases: DataFrame, cfg: Config, reviewer: Reviewer) -> DataFrame:
    return prepared(cases, cfg).select("pid", reviewer(cfg).alias("f")).select("pid", "f.*")


def default_panel(cfg: Config) -> dict[str, Reviewer]:
    return {"risk_advocate": risk_advocate_finding, "confounder_check": confounder_check_finding,
            "welfare_context": welfare_context_finding}


def _unavailable(name: str, why: str) -> Column:
    return F.lit(f"unavailable={name}" + (f":{why}" if why else ""))


def assemble(cases: DataFrame, reviewers: Mapping[str, Reviewer],
             cfg: Config | None = None) -> DataFrame:
    """Always three findings per case; a reviewer that fails or is absent says so."""
    cfg = cfg or Config()
    rows = []
    for name in REVIEWERS:
        status, body = "ok", None
        if name not in reviewers:
            status, body = "unavailable", finding(_unavailable(name, "not configured"))
        else:
            try:
                body = reviewers[name](cfg)
            except Exception as error:  # a broken reviewer must not break the run
                status, body = "unavailable", finding(_unavailable(name, type(error).__name__))
        rows.append(F.struct(F.lit(name).alias("reviewer"), F.lit(status).alias("status"),
                             body.alias("f")))
    out = prepared(cases, cfg).select("pid", F.inline(F.array(*rows)))
    return out.select("pid", "reviewer", "status", "f.*")


def run_freeze(findings: DataFrame, psi: Column, cfg: Config) -> DataFrame:
    """One row: whether escalation is frozen for the whole run, and why."""
    unheard = F.coalesce(F.bool_or((F.col("reviewer") == "confounder_check")
                                   & (F.col("status") == "unavailable")), F.lit(False))
    drift = psi >= cfg.psi_freeze
    return findings.agg(unheard.alias("unheard")).select(
        (F.col("unheard") | drift).alias("frozen"),
        F.concat_ws("; ", F.when(F.col("unheard"), F.lit(FREEZE_UNHEARD)),
                    F.when(drift, F.lit(FREEZE_DRIFT))).alias("freeze_reason"))


def decide_with_freeze(cases: DataFrame, freeze: DataFrame, cfg: Config) -> DataFrame:
    """The freeze flag is a scalar subquery: one value for the run, no join."""
    return decide(cases, cfg, freeze.select("frozen").scalar()).withColumn(
        "freeze_reason", freeze.select("freeze_reason").scalar())
