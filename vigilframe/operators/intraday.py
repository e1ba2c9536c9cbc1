"""Daytime events: a submitted questionnaire is scored, routed and folded into its case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import GATES, Config
from vigilframe.functions.scalar import settled, strings
from vigilframe.operators.verdicts import acute_items, decide
from vigilframe.session import materialised

SELF_REPORT = "self_report"
ROUTE = "mental_health_authority"


def score_responses(raw: DataFrame, cfg: Config) -> DataFrame:
    """raw: (response_id, pid, instrument, taken_at, answers) -> total or the reason it is refused.

    The total is always recomputed from the answers.
    """
    size, top = cfg.instrument_items, cfg.instrument_item_max
    refused = (
        F.when((F.size("answers") != size) | (F.col("instrument") != "PHQ9"),
               f"expected {size} PHQ-9 item scores, each 0 to {top}")
        .when(F.exists("answers", lambda a: a.isNull()), "item scores must be integers")
        .when(~F.forall("answers", lambda a: a.between(0, top)),
              f"each item score must be 0 to {top}"))
    items = F.map_from_arrays(F.array(*[F.lit(f"item_{i + 1}") for i in range(size)]),
                              F.col("answers"))
    out = raw.withColumn("refused_because", refused)
    good = F.col("refused_because").isNull()
    out = out.withColumns({
        "total": F.when(good, F.aggregate("answers", F.lit(0), lambda a, x: a + x)).cast("bigint"),
        "items": F.when(good, items)})
    return out.withColumns({
        "cutoff": F.lit(cfg.instrument_cutoff),
        "above_cutoff": F.col("total") >= cfg.instrument_cutoff,
        "acute": F.when(good, acute_items(F.col("instrument"), F.col("items"), cfg))})


def acute_routes(scored: DataFrame, cfg: Config) -> DataFrame:
    """Triggered by the instrument alone; the clock starts when the person submitted."""
    return scored.filter(F.size("acute") > 0).select(
        "response_id", "pid", "instrument", "acute", F.lit(ROUTE).alias("routed_to"), "taken_at",
        (F.col("taken_at") + F.expr(f"INTERVAL {cfg.acute_ack_hours} HOURS"))
        .alias("acknowledge_by"))


def override_records(routes: DataFrame, decided: DataFrame, cfg: Config) -> DataFrame:
    """What the ledger keeps of every acute route: the items that fired, never the answers, and the
    gates of the person's verdict that it went past."""
    failed = [F.when(~F.col(f"{g}_passed"), g) for g in GATES]
    gates = decided.select("pid", "unit_id", F.concat_ws(",", *failed).alias("bypassed_gates"))
    return routes.join(gates, "pid", "left").select(
        F.lit("override.applied").alias("action"), F.col("pid").alias("subject_pid"),
        F.coalesce("unit_id", F.lit("")).alias("unit_id"),
        F.lit("welfare:acute_risk").alias("purpose"), "response_id", "instrument",
        F.array_join("acute", ",").alias("acute_items"),
        F.coalesce("bypassed_gates", F.lit("")).alias("bypassed_gates"), "routed_to",
        F.lit(cfg.acute_ack_hours).alias("acknowledge_by_hours"), F.col("taken_at").alias("at"))


def latest_per_person(scored: DataFrame) -> DataFrame:
    """Replay of a person's submissions in any order of arrival.

    Every step of the fold takes a maximum, so a sequence of assessments equals one with the
    highest total; only the acute flag follows the last one.
    """
    return scored.filter(F.col("refused_because").isNull()).groupBy("pid").agg(
        F.max("total").alias("total"), F.bool_or("above_cutoff").alias("above_cutoff"),
        F.max_by("acute", "response_id").alias("acute"), F.count("*").alias("submissions"))


def fold(cases: DataFrame, folded: DataFrame, fractions: DataFrame, cfg: Config) -> DataFrame:
    """Fold self-reports (one row per pid) into last night's case rows; report may only raise."""
    unit = fractions.filter(F.col("domain") == SELF_REPORT).select(
        "unit_id", F.col("unit_fraction").alias("own_fraction"))
    rows = cases.drop("acute_items").join(folded, "pid").join(unit, "unit_id", "left")
    old = F.try_element_at(F.filter("deviations", lambda d: d["domain"] == SELF_REPORT), F.lit(1))
    rows = rows.withColumn("was", old)
    estimate = F.greatest(F.lit(0.0),
                          (F.col("total") - cfg.instrument_cutoff) / cfg.points_per_sd)
    breaches: list[Column] = []
    for i, days in enumerate(cfg.persistence_windows):
        existing = F.col("was")[f"breach_{i}"]
        asserted = F.lit(1.0 if days <= cfg.recall_days else cfg.recall_days / days)
        # the shortest window is always spoken for; a longer one is raised but never introduced
        known = F.lit(True) if i == 0 else existing.isNotNull()
        breaches.append(F.when(F.col("above_cutoff") & known,
                               F.greatest(F.coalesce(existing, F.lit(0.0)), asserted))
                        .otherwise(existing))
    raised = sum((F.when(F.coalesce(b, F.lit(0.0)) > 0, 1).otherwise(0) for b in breaches),
                 F.lit(0))
    tier = cfg.domain_tier[SELF_REPORT]
    fresh = F.struct(
        F.lit(SELF_REPORT).alias("domain"),
        settled(F.greatest(estimate, F.coalesce(F.col("was")["z_self"], F.lit(0.0))), 4)
        .alias("z_self"),
        F.coalesce(F.col("was")["z_unit"], F.lit(0.0)).alias("z_unit"),
        F.lit("elevated").alias("direction"), raised.cast("bigint").alias("windows_breached"),
        F.lit(tier).alias("tier"), F.lit(float(cfg.tier_weight[tier])).alias("weight"),
        *[b.alias(f"breach_{i}") for i, b in enumerate(breaches)],
        F.coalesce(F.col("was")["missing"], F.lit(0.0)).alias("missing"),
        F.coalesce(F.col("own_fraction"), F.lit(0.0)).alias("unit_fraction"),
        *[F.coalesce(F.col("was")[c], F.lit(False)).alias(c)
          for c in ("planned_leave", "training", "seasonal")])
    others = F.filter("deviations", lambda d: d["domain"] != SELF_REPORT)
    return rows.withColumns({
        "deviations": F.array_sort(F.concat(others, F.array(fresh))),
        "acute_items": F.coalesce("acute", strings(())),
    }).drop("was", "own_fraction", "acute", "above_cutoff")


def redecide(cases: DataFrame, scored: DataFrame, fractions: DataFrame, cfg: Config,
             frozen: Column | bool = False) -> DataFrame:
    """The verdict after the day's submissions, by the same gates as the night.

    The folded rows are written first: every gate reads them, and a filter on the verdict would
    otherwise be pushed down with a copy of the fold inside each of its terms.
    """
    return decide_again(cases, latest_per_person(scored), fractions, cfg, frozen)


def decide_again(cases: DataFrame, reports: DataFrame, fractions: DataFrame, cfg: Config,
                 frozen: Column | bool = False) -> DataFrame:
    """The same from self-reports that are folded already, of the day or of the replayed journal."""
    folded = materialised(fold(cases, reports, fractions, cfg), "folded")
    return decide(folded, cfg, frozen, detail=False)
