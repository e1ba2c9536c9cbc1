"""Confounder rules, the playbook and the four gates, as expressions over one case row.

Written as SQL text with lateral aliases: one projection per step, parsed once in the JVM, instead
of thousands of column objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.config import CONFOUNDER_LABEL, GATES, PLAYBOOK, Config

CONSENTED = (
    "filter(deviations, d -> status IN ('ACTIVE', 'PARTIAL') AND array_contains(scope, d.domain)) "
    "AS consented")


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values) -> str:
    return "CAST(array(" + ", ".join(quote(v) for v in values) + ") AS ARRAY<STRING>)"


def sql_fixed(expr: str, digits: int) -> str:
    return f"format_string('%.{digits}f', round(round(CAST({expr} AS DOUBLE), 10), {digits}))"


def sql_percent(expr: str) -> str:
    return f"concat(CAST(CAST(rint(round(({expr}) * 100, 9)) AS BIGINT) AS STRING), '%')"


def sql_sum(array: str, var: str, term: str) -> str:
    return f"aggregate({array}, 0D, (acc, {var}) -> acc + {term})"


# -------------------------------------------------------------------- confounders ---
def rule_conditions(cfg: Config) -> list[tuple[str, str, str]]:
    """(rule, when it fires on deviation ``d``, what to say).  A new rule is one more entry."""
    tempo, gap = cfg.op_tempo_fraction, cfg.data_gap_fraction
    return [
        ("unit_op_tempo", f"round(d.unit_fraction, 9) >= {tempo}",
         f"concat({sql_percent('d.unit_fraction')}, ' of the unit cohort (', cohort_size, "
         "' personnel) deviates in ', d.domain, ' in the same direction; threshold is ', "
         f"{sql_percent(str(tempo))})"),
        ("planned_leave_cycle", "d.planned_leave",
         "concat('the ', d.domain, ' deviation coincides with an approved leave calendar entry')"),
        ("scheduled_training", "d.training",
         "concat(d.domain, ' load is explained by a scheduled training assignment')"),
        ("seasonal_roster", "d.seasonal",
         "concat('the same ', d.domain, "
         "\" deviation is present in the prior year's same window\")"),
        ("data_gap", f"d.missing > {gap}",
         f"concat({sql_percent('d.missing')}, ' of ', d.domain, ' records are missing in the "
         f"window; above ', {sql_percent(str(gap))}, ' the window is an artefact')"),
    ]


def hits_expr(cfg: Config) -> str:
    """Every rule that fires on every deviating domain, consented or not."""
    entries = ", ".join(
        f"IF({fires}, named_struct('domain', d.domain, 'rule', {quote(rule)}, "
        f"'mass', {float(cfg.masses[rule])}D, 'label', {quote(CONFOUNDER_LABEL[rule])}, "
        f"'detail', {detail}), NULL)"
        for rule, fires, detail in rule_conditions(cfg))
    return ("flatten(transform(deviations, d -> "
            f"filter(array({entries}), h -> h IS NOT NULL))) AS hits")


def detect(cases: DataFrame, cfg: Config) -> DataFrame:
    return cases.selectExpr("*", hits_expr(cfg))


def hits_long(cases: DataFrame) -> DataFrame:
    return cases.select("pid", "unit_id", F.inline("hits"))


# ----------------------------------------------------------------------- playbook ---
def playbook_order() -> list[tuple]:
    """Mental health first, then by code."""
    return sorted(PLAYBOOK, key=lambda item: (item[4] != "mental_health", item[0]))


DRIVER_KEYS = (
    "array_except(concat(transform(deviations, d -> d.domain), "
    "IF(risk_status = 'ok', transform(drivers, r -> r.feature), CAST(array() AS ARRAY<STRING>)), "
    "IF(size(acute_items) > 0, concat(array('acute'), acute_items), "
    "CAST(array() AS ARRAY<STRING>)), "
    "IF(clinician_concern, array('clinician_concern'), CAST(array() AS ARRAY<STRING>))), "
    "suppressed_drivers)")


def match_expr(keys: str) -> str:
    """Codes of every action with a topic inside some key, in playbook order."""
    entries = []
    for code, _, _, topics, _ in playbook_order():
        some = " OR ".join(f"contains(k, {quote(t)})" for t in topics)
        entries.append(f"IF(exists({keys}, k -> {some}), {quote(code)}, NULL)")
    return f"filter(array({', '.join(entries)}), c -> c IS NOT NULL)"


def duplicate_expr(matched: str, active: str) -> str:
    """First candidate that is already active, else the first whose topics are all covered."""
    topics = " ".join(f"WHEN {quote(code)} THEN {text_array(t)}" for code, _, _, t, _ in PLAYBOOK)
    covered = (f"flatten(transform({active}, c -> CASE c {topics} "
               "ELSE CAST(array() AS ARRAY<STRING>) END))")
    first = [f"IF(array_contains({matched}, {quote(code)}) AND "
             f"array_contains({active}, {quote(code)}), {quote(code)}, NULL)"
             for code, *_ in playbook_order()]
    second = [f"IF(array_contains({matched}, {quote(code)}) AND "
              f"size(array_except({text_array(t)}, {covered})) = 0, {quote(code)}, NULL)"
              for code, _, _, t, _ in playbook_order()]
    return f"coalesce({', '.join(first + second)})"


# -------------------------------------------------------------------------- gates ---
def evidence_exprs(cfg: Config) -> list[str]:
    w_volume, w_breadth, w_t1 = cfg.evidence_weights
    return [
        sql_sum("consented", "d", "d.weight") + " AS weighted_volume",
        "CAST(size(array_distinct(transform(consented, d -> d.domain))) AS BIGINT) "
        "AS distinct_domains",
        "exists(consented, d -> d.tier = 'T1') AS has_t1",
        f"least(1D, weighted_volume / {cfg.evidence_saturation}D) AS volume",
        f"least(1D, distinct_domains / {cfg.evidence_breadth}D) AS breadth",
        f"least(1D, {w_volume}D * volume + {w_breadth}D * breadth + {w_t1}D * CAST(has_t1 AS INT)) "
        "AS evidence",
        f"concat('evidence = {w_volume:.2f}x', {sql_fixed('volume', 3)}, ' + {w_breadth:.2f}x', "
        f"{sql_fixed('breadth', 3)}, ' + {w_t1:.2f}x', CAST(CAST(has_t1 AS INT) AS STRING), ' = ', "
        f"{sql_fixed('evidence', 3)}) AS evidence_formula",
    ]


# Support from other domains, discounted by benign explanations they do not share.  The pairs are
# inside one row and bounded by the number of domains squared.
SUPPORT = """transform(consented, d -> named_struct(
  'domain', d.domain,
  'credible', aggregate(
    filter(consented, o -> o.domain <> d.domain AND o.direction = d.direction), 0D,
    (acc, o) -> acc + o.weight * greatest(0D, 1D - least(1D, aggregate(
      filter(hits, h -> h.domain = o.domain
             AND NOT exists(hits, g -> g.domain = d.domain AND g.rule = h.rule)),
      0D, (m, h) -> m + h.mass)))),
  'available', aggregate(
    filter(consented, o -> o.domain <> d.domain AND o.direction = d.direction), 0D,
    (acc, o) -> acc + o.weight),
  'against', aggregate(filter(consented, o -> o.direction <> d.direction), 0D,
                       (acc, o) -> acc + o.weight)
             + aggregate(filter(hits, h -> h.domain = d.domain), 0D, (m, h) -> m + h.mass)))
  AS support"""
AGREEMENT = """transform(support, t -> named_struct(
  'domain', t.domain, 'credible', t.credible, 'available', t.available, 'against', t.against,
  'agree', IF(t.available + t.against = 0, 0D, t.credible / (t.available + t.against)))) AS terms"""


def consistency_exprs() -> list[str]:
    line = (f"concat(t.domain, ': ', {sql_fixed('t.credible', 2)}, '/(', "
            f"{sql_fixed('t.available', 2)}, '+', {sql_fixed('t.against', 2)}, ')=', "
            f"{sql_fixed('t.agree', 3)})")
    return [
        "CAST(size(terms) AS BIGINT) AS n_domains",
        f"IF(size(terms) = 0, 0D, least(1D, {sql_sum('terms', 't', 't.agree')} / size(terms))) "
        "AS consistency",
        f"array_join(transform(terms, t -> {line}), ' | ') AS per_domain",
        "array_join(array_sort(array_distinct(transform(hits, h -> h.rule))), ',') AS confounders",
        "IF(size(terms) = 0, 'consistency = 0.000 (no deviating domain)', concat("
        f"'consistency = mean(', array_join(transform(terms, t -> {sql_fixed('t.agree', 3)}), ', '),"
        f" ') = ', {sql_fixed('consistency', 3)})) AS consistency_formula",
    ]


def persistence_exprs(cfg: Config) -> list[str]:
    """Weight-mean of the breach share per window, over the domains observed in that window."""
    out = []
    for i in range(len(cfg.persistence_windows)):
        seen = f"filter(consented, d -> d.breach_{i} IS NOT NULL)"
        weight = sql_sum(seen, "d", "d.weight")
        value = sql_sum(seen, "d", f"d.weight * least(1D, greatest(0D, d.breach_{i}))")
        out.append(f"IF({weight} = 0, 0D, {value} / {weight}) AS window_{i}")
    parts = [f"{w}D * window_{i}" for i, w in enumerate(cfg.persistence_weights)]
    shown = [f"concat('{w:.2f}x', {sql_fixed(f'window_{i}', 3)})"
             for i, w in enumerate(cfg.persistence_weights)]
    return out + [
        f"least(1D, greatest(0D, {' + '.join(parts)})) AS persistence",
        f"concat(concat_ws(' + ', {', '.join(shown)}), ' = ', {sql_fixed('persistence', 3)}) "
        "AS persistence_formula",
    ]


def actionability_exprs(cfg: Config) -> list[str]:
    """A product, not a sum: no action, a duplicate or no consent each force it to zero."""
    flag = "CAST({} AS INT)".format
    room = f"({cfg.capacity_floor}D + {cfg.capacity_span}D * {flag('capacity')})"
    return [
        "size(matched) > 0 AS has_match",
        duplicate_expr("matched", "active_codes") + " AS duplicate",
        "duplicate IS NULL AS not_duplicate",
        "welfare_contact AND status IN ('ACTIVE', 'PARTIAL') AS contact_ok",
        f"least(1D, {flag('has_match')} * {flag('not_duplicate')} * {flag('contact_ok')} * {room}) "
        "AS actionability",
        f"concat('actionability = ', concat_ws(' x ', {flag('has_match')}, {flag('not_duplicate')}, "
        f"{flag('contact_ok')}), ' x ({cfg.capacity_floor:.2f} + {cfg.capacity_span:.2f}x', "
        f"{flag('capacity')}, ') = ', {sql_fixed('actionability', 3)}) AS actionability_formula",
    ]


def summary_exprs(cfg: Config) -> list[str]:
    passed = [f"round({g}, 9) >= {float(cfg.thresholds[g])}D AS {g}_passed" for g in GATES]
    failed = ", ".join(f"IF({g}_passed, NULL, '{g}')" for g in GATES)
    product = " * ".join(f"pow({g}, {float(cfg.exponents[g])}D)" for g in GATES)
    return passed + [
        f"filter(array({failed}), g -> g IS NOT NULL) AS failed_gates",
        f"least(1D, {product}) AS composite",
    ]


def evaluate(cases: DataFrame, cfg: Config) -> DataFrame:
    """All four gates, their pass flags, the failed list and the display composite."""
    return (
        cases.selectExpr("*", hits_expr(cfg), CONSENTED, f"{DRIVER_KEYS} AS driver_keys")
        .selectExpr("*", SUPPORT, f"{match_expr('driver_keys')} AS matched",
                    *evidence_exprs(cfg), *persistence_exprs(cfg))
        .selectExpr("*", AGREEMENT, *actionability_exprs(cfg))
        .selectExpr("*", *consistency_exprs())
        .selectExpr("*", *summary_exprs(cfg))
    )
