"""Read views over one run: funnel, ranked lists, explanations and what-if sweeps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import DRIVER_WORDS, GATES, PLAYBOOK, Config
from vigilframe.functions.scalar import fixed, lookup, reaches
from vigilframe.operators import feedback

CASES_PER_OFFICER = 6
SHORT_PID = 12
NO_FAILED_GATE = 99.0


# ------------------------------------------------------------------------- the funnel ---
def funnel(cases: DataFrame) -> DataFrame:
    decision = F.col("decision")
    return cases.agg(
        F.count("*").alias("screened"),
        F.count_if(decision != "CLEARED").alias("deviating"),
        F.count_if(decision != "CLEARED").alias("reviewed"),
        F.count_if(decision.isin("ESCALATE", "IMMEDIATE_ESCALATE")).alias("escalated"),
        F.count_if(decision == "MONITOR").alias("monitored"),
        F.count_if(decision == "NO_FLAG").alias("no_flag"),
        F.count_if(decision == "CLEARED").alias("cleared"))


def headline(counts: DataFrame, degraded: Column, absent: Column) -> DataFrame:
    text = F.concat(
        F.lit("Overnight: "), F.format_number("screened", 0), F.lit(" screened · "),
        F.col("deviating").cast("string"), F.lit(" deviating · "),
        F.col("reviewed").cast("string"), F.lit(" reviewed · "),
        F.col("escalated").cast("string"), F.lit(" escalated"))
    status = F.when((degraded > 0) | (absent > 0), "PARTIAL").otherwise("COMPLETE")
    return counts.select(text.alias("headline"), status.alias("status"))


def units_covered(cases: DataFrame) -> DataFrame:
    """Distinct units in order; a unit list is written out, never gathered into one row."""
    return cases.filter(F.col("unit_id") != "").select("unit_id").distinct().orderBy("unit_id")


def run_summary(cases: DataFrame, run_id: str, as_of: date, cfg: Config,
                stages: DataFrame | None = None) -> DataFrame:
    """One JSON document of counts.  ``stages`` has one row per stage of the run (eight)."""
    counts = funnel(cases)
    body = F.to_json(F.struct(
        F.lit(run_id).alias("run_id"), F.lit(as_of.isoformat()).alias("as_of"),
        F.lit(cfg.version).alias("config_version"), *counts.columns))
    if stages is None:
        return counts.select(body.alias("summary"))
    listed = stages.agg(F.array_sort(F.collect_list(F.struct(
        "name", "status", "rows_in", "rows_out", "seconds", "detail"))).alias("s")).scalar()
    return counts.withColumn("stages", listed).select(F.to_json(F.struct(
        F.lit(run_id).alias("run_id"), F.lit(as_of.isoformat()).alias("as_of"),
        F.lit(cfg.version).alias("config_version"), *counts.columns, "stages")).alias("summary"))


# ---------------------------------------------------------------------- ranked lists ---
def caseload(verdicts: DataFrame) -> DataFrame:
    """Named cases: immediate ones first, then by display composite."""
    named = verdicts.filter("named")
    return named.orderBy((F.col("decision") != "IMMEDIATE_ESCALATE"), F.col("composite").desc(),
                         "pid")


def scoped_caseload(verdicts: DataFrame, scopes: DataFrame, book: DataFrame) -> DataFrame:
    """Named cases per operator: an officer's own units; overrides of every unit for clinicians.

    scopes: (operator, role, unit_id); book: (pid, outcome, at), the officer log.
    """
    named = verdicts.filter("named").select("pid", F.col("unit_id").alias("case_unit"),
                                            "decision", "composite", "override")
    officers = scopes.filter(F.col("role") == "welfare_officer")
    mine = officers.join(named, F.col("unit_id") == F.col("case_unit"))
    # one shared queue for the role: a row per clinician and override would be a product
    every = named.filter("override").select(
        F.lit("*").alias("operator"), F.lit("mental_health_authority").alias("role"),
        F.col("case_unit").alias("unit_id"), "*")
    listed = mine.unionByName(every)
    # contacted: the log names the person; closed: it holds a valid outcome; between them it blocks
    contacted = book.groupBy("pid").agg(F.lit(True).alias("contacted"))
    closed = feedback.latest_closes(book).select("pid", F.col("outcome").alias("closed_as"))
    out = listed.join(contacted, "pid", "left").join(closed, "pid", "left")
    return out.withColumns({
        "contacted": F.coalesce("contacted", F.lit(False)),
        "blocking": F.col("contacted").isNotNull() & F.col("closed_as").isNull(),
        "closed_as": F.coalesce("closed_as", F.lit("")),
    })


def monitored(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("decision") == "MONITOR")


def closest_miss(cfg: Config) -> Column:
    gaps = [F.when(~F.col(f"{g}_passed"), F.lit(float(cfg.thresholds[g])) - F.col(g))
            for g in GATES]
    return F.coalesce(F.least(*gaps), F.lit(NO_FAILED_GATE))


def refused(verdicts: DataFrame, cfg: Config, limit: int) -> DataFrame:
    """Nearest refusals first.  The limit is the report; it plans as a distributed top-k."""
    held = verdicts.filter(~F.col("named")).withColumn(
        "closest_miss", F.round(closest_miss(cfg), 4))
    top = held.orderBy(F.round("closest_miss", 4), "pid").limit(limit)
    return top.withColumn("short_pid", F.substring("pid", 1, SHORT_PID))


# ----------------------------------------------------------------------- explanations ---
def gate_structs(cfg: Config) -> Column:
    return F.array(*[F.struct(
        F.lit(g).alias("gate"), F.round(g, 4).alias("value"),
        F.lit(float(cfg.thresholds[g])).alias("threshold"),
        F.col(f"{g}_passed").alias("passed"), F.col(f"{g}_formula").alias("formula"))
        for g in GATES])


def own_reasons(verdicts: DataFrame, cfg: Config) -> DataFrame:
    """The account the person is owed: the same gates the officer saw."""
    message = F.when(F.col("named"), "named_with_reasons").otherwise("withheld_with_reasons")
    return verdicts.select(
        "pid", F.col("named").alias("named_to_an_officer"), message.alias("message"),
        F.inline(gate_structs(cfg)))


def plain_driver(feature: Column) -> Column:
    """A feature name in the words of the person it is about."""
    window = (
        F.when(feature.contains("_30d"), " over the last 30 days")
        .when(feature.contains("_90d"), " over the last 90 days")
        .when(feature.contains("_7d"), " over the last week")
        .when(feature.endswith("_slope"), " — and the direction it has been moving")
        .otherwise(""))
    out = None
    for prefix, words in DRIVER_WORDS.items():
        text = F.concat(F.lit(words), window)
        out = (F.when(feature.startswith(prefix), text) if out is None
               else out.when(feature.startswith(prefix), text))
    return out.otherwise(F.translate(feature, "_", " "))


def case_payload(verdicts: DataFrame, cfg: Config) -> DataFrame:
    actions = {code: F.struct(F.lit(code).alias("code"), F.lit(title).alias("title"),
                              F.lit(why).alias("rationale"), F.lit(who).alias("authority"))
               for code, title, why, _, who in PLAYBOOK}
    gates = F.transform(gate_structs(cfg), lambda g: F.struct(
        g["gate"].alias("name"), g["value"].alias("value"), g["threshold"].alias("threshold"),
        g["passed"].alias("passed"), g["formula"].alias("formula")))
    document = F.to_json(F.struct(
        "pid", "unit_id", "decision", "reason", F.round("composite", 4).alias("composite"),
        "override", "config_version", gates.alias("gates"),
        F.transform("recommended", lambda c: lookup(actions, c)).alias("recommended"),
        F.transform("mind_change", lambda m: m.dropFields("stuck", "shortfall", "gate_order"))
        .alias("mind_change")))
    return verdicts.select("pid", document.alias("payload"))


def gate_table(verdicts: DataFrame) -> DataFrame:
    signs = [F.concat(F.lit(g[:4]), F.when(F.col(f"{g}_passed"), "+").otherwise("-"),
                      fixed(F.col(g), 2)) for g in GATES]
    return verdicts.select("pid", "decision", F.concat_ws(" ", *signs).alias("gates"),
                           "reason", F.substring("reason", 1, 38).alias("short_reason"))


# ------------------------------------------------------------------------ what-if sweep ---
def threshold_sweep(verdicts: DataFrame, screened: DataFrame, thresholds: list[float]) -> DataFrame:
    """Re-decide at each evidence threshold in one pass: one conditional count per threshold."""
    others = (F.col("consistency_passed") & F.col("persistence_passed")
              & F.col("actionability_passed") & (F.size("consented") > 0))
    counts = verdicts.agg(*[
        F.count_if(F.col("override") | (others & reaches(F.col("evidence"), t))).alias(f"t{i}")
        for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("escalated"))
                     for i, t in enumerate(thresholds)])
    total = screened.select("screened").scalar()
    return counts.select(F.inline(rows)).withColumns({
        "rate": F.col("escalated") / total,
        "officers": F.ceil(F.col("escalated") / CASES_PER_OFFICER),
    })
