"""The decision, in a fixed order of precedence, and what would have changed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import GATES, LEGAL_STATES, PLAYBOOK, Config
from vigilframe.functions.ordered import WIDTH, lagged
from vigilframe.functions.scalar import fixed, lookup, present, shortest, strings
from vigilframe.operators.gates import evaluate

NAMED = ("ESCALATE", "IMMEDIATE_ESCALATE")
OVERRIDE_REASON = (
    "acute-risk item endorsed on a validated instrument, or a direct concern raised by an "
    "authorised clinician"
)
FROZEN_REASON = (
    "all gates passed but escalation is frozen for this run (reviewer unavailable or model drift "
    "beyond threshold)"
)
MENTAL_HEALTH_CODES = tuple(code for code, _, _, _, who in PLAYBOOK if who == "mental_health")


def acute_items(instrument: Column, items: Column, cfg: Config) -> Column:
    """Watched items endorsed on a response; ``items`` is MAP<STRING, INT>."""
    watched = lookup({k: strings(v) for k, v in cfg.acute_items.items()}, instrument, strings(()))
    return F.filter(watched, lambda name: F.coalesce(
        F.try_element_at(items, name), F.lit(0)) > cfg.acute_minimum)


def decide(cases: DataFrame, cfg: Config, frozen: Column | bool = False,
           detail: bool = True) -> DataFrame:
    """Evaluate the gates and add decision, reason and recommendation.

    ``detail`` also adds ``mind_change``, the counterfactual of every failed gate.
    """
    out = evaluate(cases, cfg)
    if detail:
        out = counterfactuals(out, cfg)
    freeze = frozen if isinstance(frozen, Column) else F.lit(bool(frozen))
    override = (F.size("acute_items") > 0) | F.col("clinician_concern")
    no_basis = F.size("consented") == 0
    weak = ~F.col("evidence_passed") | ~F.col("consistency_passed")
    trigger = F.when(F.size("acute_items") > 0,
                     F.concat(F.lit("acute item(s) "), F.array_join("acute_items", ", "))
                     ).otherwise(F.lit("clinician concern raised"))
    ladder: list[tuple[Column, str, Column]] = [
        (override, "IMMEDIATE_ESCALATE", F.concat(F.lit("safety override: "), trigger)),
        (no_basis, "NO_FLAG", F.lit("no consent basis for any deviating domain")),
        (~F.col("actionability_passed"), "NO_FLAG",
         F.lit("no available or non-duplicate welfare action")),
        (~F.col("persistence_passed"), "MONITOR", F.lit("not yet sustained")),
        (weak, "MONITOR", F.lit("insufficient or confounded evidence")),
        (freeze, "MONITOR", F.lit(FROZEN_REASON)),
        (F.lit(True), "ESCALATE", F.lit("all four gates passed")),
    ]
    decision = reason = F
    for i, (when, label, why) in enumerate(ladder):
        decision = decision.when(when, F.lit(label)) if i else F.when(when, F.lit(label))
        reason = reason.when(when, why) if i else F.when(when, why)
    urgent = F.array_intersect(F.col("matched"), strings(MENTAL_HEALTH_CODES))
    recommended = (
        F.when(override, F.when(F.size(urgent) > 0, urgent).otherwise(F.col("matched")))
        .when(F.col("decision") == "ESCALATE", F.col("matched"))
        .otherwise(strings(())))
    out = out.withColumns({"decision": decision, "reason": reason, "override": override})
    last = {} if not detail else {
        "mind_change": F.when(F.col("override"), F.filter("mind_change", lambda m: F.lit(False)))
        .otherwise(F.col("mind_change"))}
    return out.withColumns({
        **last,
        "recommended": recommended,
        "named": F.col("decision").isin(*NAMED),
        "config_version": F.lit(cfg.version),
    })


# ---------------------------------------------------------------- counterfactuals ---
def told(code: str, *values: Column) -> Column:
    """A statement: its code and the values it is about."""
    return F.concat(F.lit(f"{code}("), F.concat_ws(",", *[v.cast("string") for v in values]), F.lit(")"))


def statements(cfg: Config) -> dict[str, tuple[Column, Column, Column]]:
    """By gate: why it failed, what would change that, and whether anything can.

    One table of codes with their conditions and values; a page words them for the reader.
    """
    w_volume, _, w_t1 = cfg.evidence_weights
    windows = cfg.persistence_windows
    to_evidence, to_persistence = (F.round(F.lit(float(cfg.thresholds[g])) - F.col(g), 9)
                                   for g in ("evidence", "persistence"))
    # evidence: units of corroboration that are short, and in how many service records they would come
    units = to_evidence / w_volume * cfg.evidence_saturation
    records = F.ceil(F.round(units / float(cfg.tier_weight["T2"]), 9))
    untold = ~F.col("has_t1")
    # persistence: breach share of each window, and days of the middle one that would close the gap
    shares = [F.round(F.col(f"window_{i}"), 4) for i in range(len(windows))]
    rise = to_persistence / cfg.persistence_weights[1]
    days = F.ceil(F.round(F.least(1.0 - shares[1], rise) * windows[1], 9))
    by_days = (days > 0) & (F.round(shares[1] + rise, 9) <= 1.0)
    # consistency: the rules that explain a domain away, or domains that disagree
    hits, free = F.col("hits"), F.size("hits") == 0
    running, twice = F.coalesce("duplicate", F.lit("")), ~F.col("not_duplicate")

    def hit(code: str) -> Column:
        return F.transform(hits, lambda h: told(code, h["rule"], h["domain"], fixed(h["mass"], 2)))

    return {
        "evidence": (
            present(told("volume", shortest(F.col("weighted_volume"), 4), F.lit(cfg.evidence_saturation)),
                    told("domains", F.col("distinct_domains"), F.lit(cfg.evidence_breadth)),
                    F.when(untold, told("no_self_report"))),
            present(F.when(untold & (to_evidence <= w_t1), told("self_report", fixed(F.lit(w_t1), 2))),
                    F.when(F.col("volume") < 1.0, told("service_records", records, fixed(units, 2))),
                    F.when(F.col("breadth") < 1.0, told(
                        "more_domains", F.lit(cfg.evidence_breadth) - F.col("distinct_domains")))),
            F.lit(True)),
        "consistency": (
            F.when(free, F.array(told("domains_disagree", F.col("n_domains")))).otherwise(hit("explained")),
            F.when(free, F.array(told("same_direction"))).otherwise(hit("outlasts")), ~free),
        "persistence": (
            F.array(told("breach", *[F.concat(F.lit(f"{w}d="), shortest(x, 4)) for w, x in zip(windows, shares)])),
            F.array(F.when(by_days, told("days_within", days, F.lit(windows[1]))).otherwise(
                told("throughout", F.lit(windows[2])))), F.lit(True)),
        "actionability": (
            present(F.when(~F.col("contact_ok"), told("no_contact_consent")),
                    F.when(~F.col("has_match"), told("no_playbook_match")),
                    F.when(twice, told("running", running)),
                    F.when(~F.col("capacity"), told("no_capacity"))),
            present(F.when(~F.col("contact_ok"), told("contact_consent")),
                    F.when(~F.col("has_match"), told("playbook_entry")),
                    F.when(twice, told("concluded", running)),
                    F.when(~F.col("capacity"), told("capacity"))), ~twice),
    }


def counterfactuals(gated: DataFrame, cfg: Config) -> DataFrame:
    """``mind_change``: one item per failed gate, recoverable first, then smallest shortfall."""
    parts = statements(cfg)
    items = []
    for order, gate in enumerate(GATES):
        because, changes, recoverable = parts[gate]
        threshold = float(cfg.thresholds[gate])
        current = F.round(F.col(gate), 4)
        items.append(F.when(~F.col(f"{gate}_passed"), F.struct(
            (~recoverable).cast("int").alias("stuck"),
            F.round(F.lit(threshold) - current, 9).alias("shortfall"),
            F.lit(order).alias("gate_order"), F.lit(gate).alias("gate"),
            current.alias("current"), F.lit(threshold).alias("required"),
            because.alias("failed_because"), changes.alias("would_change_if"),
            recoverable.alias("recoverable"))))
    # structs compare field by field, so the leading fields are the sort key
    return gated.withColumn("mind_change", F.array_sort(present(*items)))


# -------------------------------------------------------------- state transitions ---
def illegal_transitions(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """Moves in a (pid, seq, state) log that the state table does not allow."""
    moves = lagged(log, ["pid"], "seq", "state", "previous", width).filter(
        F.col("previous").isNotNull())
    allowed = lookup({s: strings(t) for s, t in LEGAL_STATES.items()}, F.col("previous"),
                     strings(()))
    return moves.filter(~F.array_contains(allowed, F.col("state"))).select(
        "pid", "seq", "previous", "state")
