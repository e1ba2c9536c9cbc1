"""Words, voice, and whether they agree: cues, frames, gaps, strain and change over time."""

from __future__ import annotations

import re
from bisect import bisect_right
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.median import grouped_median
from vigilframe.functions.ordered import lagged, running
from vigilframe.functions.scalar import clamp, fixed, let, settled
from vigilframe.session import materialised

TAIL_WORDS = 6
UNIT_STDEV = 0.15
MAD_SCALE = 1.4826
NO_TEXT = ""
DAY_MS = 86_400_000


# --------------------------------------------------------------------------- words ---
CUE = ("array<struct<rank: double, order: int, start: int, phrase: string, kind: string, "
       "confidence: double>>")


def half_up(value: float, places: int) -> float:
    step = Decimal(1).scaleb(-places)
    return float(Decimal(repr(value)).quantize(step, ROUND_HALF_UP))


def cues(column: str, cfg: Config, clause_break: str) -> Column:
    """Every cue that is not negated; array of (rank, order, start, phrase, kind, confidence).

    One pass over a batch of texts with every pattern compiled once.  A cue is negated by a negator
    among the last words between the clause break before it and itself; clause breaks are located
    once per text, and only in texts that hold a cue.
    """
    bank = [(order, re.compile(p), kind, float(base)) for order, (p, kind, base) in enumerate(cfg.cues)]
    anything = re.compile("|".join(f"(?:{p})" for p, _, _ in cfg.cues))
    breaks, tail_words = re.compile(clause_break), TAIL_WORDS
    negators, hedges = tuple(cfg.negators), tuple(cfg.hedges)
    contrasts = tuple(f" {c} " for c in cfg.contrasts)
    # a confidence takes one of four values for each cue
    sure = {(order, h, c): half_up(half_up(min(1.0, base + h * cfg.hedge_bonus + c * cfg.contrast_bonus),
                                           10), 3)
            for order, _, _, base in bank for h in (False, True) for c in (False, True)}

    def search(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found, ends = [], None
            # one search for any cue; most texts hold none
            if text is not None and anything.search(low := text.lower()):
                for order, pattern, kind, _ in bank:
                    for match in pattern.finditer(low):
                        if ends is None:
                            ends = [m.end() for m in breaks.finditer(low)]
                            padded = f" {low} "
                            bonus = any(h in low for h in hedges), any(c in padded for c in contrasts)
                        at = match.start()
                        k = bisect_right(ends, at)
                        clause = low[ends[k - 1] if k else 0:at]
                        tail = " ".join(clause.split()[-tail_words:])
                        if not any(n in tail for n in negators):
                            value = sure[(order, *bonus)]
                            found.append((-value, order, at, match.group(), kind, value))
            out.append(found if text is not None else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(search, CUE)(F.col(column))


def best_cue(utterances: DataFrame, cfg: Config, clause_break: str) -> DataFrame:
    """Utterances that make a claim, with their strongest cue (the first one on ties).

    The cue comes out of a generator, so a later filter does not evaluate the search again.
    """
    strongest = F.slice(F.array_sort(cues("text", cfg, clause_break)), 1, 1)
    return utterances.select("*", F.explode(strongest).alias("cue"))


def acute_phrases(text: Column, cfg: Config) -> Column:
    """The literal patterns heard in a text.

    One search for any of them comes first: nearly every text holds none, and is read once.
    """
    lowered = F.lower(F.coalesce(text, F.lit(NO_TEXT)))
    heard = F.array_compact(F.array(*[F.when(lowered.rlike(p), F.lit(p)) for p in cfg.acute_phrases]))
    any_of = lowered.rlike("|".join(f"(?:{p})" for p in cfg.acute_phrases))
    return F.when(any_of, heard).otherwise(F.array().cast("array<string>"))


# -------------------------------------------------------------------------- frames ---
def trustworthy(frames: DataFrame, cfg: Config) -> DataFrame:
    return frames.filter((F.col("voiced_fraction") >= cfg.voiced_minimum)
                         & (F.col("duration_s") >= cfg.frame_seconds))


def band_bounds(cfg: Config, feature: Column, part: int) -> Column:
    out = None
    for band in cfg.bands:
        value = F.lit(band[part])
        out = (F.when(feature == band[0], value) if out is None
               else out.when(feature == band[0], value))
    return out


def divergence(value: Column, normal: Column, notable: Column) -> Column:
    return clamp((value - normal) / (notable - normal))


def measurements(frames: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """Trustworthy frames, one row per available feature, with its divergence from the band."""
    long = trustworthy(frames, cfg).select(*keys, F.inline(F.array(*[
        F.struct(F.lit(b[0]).alias("feature"), F.col(b[0]).alias("value")) for b in cfg.bands])))
    normal, notable = (band_bounds(cfg, F.col("feature"), i) for i in (1, 2))
    # generous limits for bucketing: three spans on either side of the band
    low, high = F.least(normal, notable), F.greatest(normal, notable)
    return long.filter("value IS NOT NULL").withColumns({
        "divergence": divergence(F.col("value"), normal, notable),
        "low": low - 3 * (high - low), "high": high + 3 * (high - low),
        "zero": F.lit(0.0), "one": F.lit(1.0)})


# ---------------------------------------------------------------- gap: claim and voice ---
def frames_near(utterances: DataFrame, frames: DataFrame, cfg: Config) -> DataFrame:
    """Frames of the same session within the window around each utterance.

    Both sides are cut into slots of one window, so a long session is spread over its slots and an
    utterance only meets its own and the two neighbouring ones.
    """
    w = cfg.gap_window_ms
    slot = F.floor(F.col("at_ms") / w)
    asked = utterances.withColumn("said_at", F.col("at_ms")).withColumn(
        "slot", F.explode(F.array(slot - 1, slot, slot + 1))).drop("at_ms")
    heard = frames.withColumn("slot", slot)
    joined = asked.join(heard, ["session_id", "slot"])
    return joined.filter(F.abs(F.col("at_ms") - F.col("said_at")) <= w).drop("slot")


def gap_assessments(claims: DataFrame, frames: DataFrame, cfg: Config) -> DataFrame:
    """claims: (session_id, utterance_id, at_ms, cue), one row per claim -> its assessment.

    The claims are written first, without the text: both readers below would search it again.
    """
    claims = materialised(claims.drop("text"), "claims")
    near = frames_near(claims.select("session_id", "utterance_id", "at_ms"),
                       trustworthy(frames, cfg), cfg)
    # the window bounds the frames of one utterance, so a per-utterance median is small
    medians = near.groupBy("utterance_id").agg(
        F.count("*").alias("usable"),
        *[F.percentile(b[0], F.lit(0.5)).alias(b[0]) for b in cfg.bands])
    out = claims.join(medians, "utterance_id", "left").withColumn(
        "usable", F.coalesce("usable", F.lit(0)))
    moved = F.filter(F.array(*[F.struct(
        F.lit(name).alias("feature"), settled(F.col(name), 4).alias("value"),
        divergence(F.col(name), F.lit(normal), F.lit(notable)).alias("raw"),
        F.lit(weight).alias("weight")) for name, normal, notable, weight, _ in cfg.bands]),
        lambda e: F.coalesce(F.round(e["raw"], 9) >= cfg.feature_divergence, F.lit(False)))
    out = out.withColumn("moved", moved)
    weight = F.aggregate("moved", F.lit(0.0), lambda a, e: a + e["weight"])
    pulled = F.aggregate("moved", F.lit(0.0),
                         lambda a, e: a + settled(e["raw"], 3) * e["weight"])
    strength = settled(F.try_divide(pulled, weight) * F.col("cue.confidence"), 4)
    strong = F.col("cue.confidence") >= cfg.cue_minimum
    count = F.size("moved")
    reason = (
        F.when(~strong, F.concat(F.lit("weak_cue("), F.col("cue.phrase"), F.lit(","),
                                 fixed(F.col("cue.confidence"), 2), F.lit(")")))
        .when(F.col("usable") == 0, "unvoiced()")
        .when(count < cfg.gap_features, F.concat(
            F.lit("features("), count.cast("string"), F.lit(f",{cfg.gap_features})")))
        .when(strength < cfg.gap_divergence, F.concat(
            F.lit("divergence("), fixed(strength, 2), F.lit(f",{cfg.gap_divergence})")))
        .otherwise("gap"))
    measured = strong & (F.col("usable") > 0) & (count >= cfg.gap_features)
    out = out.withColumns({
        "divergence": F.when(measured, strength).otherwise(0.0), "reason": reason,
        "features": count.cast("bigint")})
    return out.withColumn("raised", F.col("reason") == "gap").withColumn(
        "severity", severity(F.col("divergence"), 0.40))


def severity(value: Column, moderate: float) -> Column:
    return (F.when(value >= 0.66, "marked").when(value >= moderate, "moderate").otherwise("slight"))


# ------------------------------------------------------------------ strain, summaries ---
def session_medians(frames: DataFrame, cfg: Config) -> DataFrame:
    """Median per session and feature, the only thing kept of a sitting."""
    rows = measurements(frames, ["session_id"], cfg)
    return grouped_median(rows, ["session_id", "feature"], "value", "low", "high")


def summaries(frames: DataFrame, cfg: Config) -> DataFrame:
    """One row per session, six medians rounded to five places."""
    rounded = session_medians(frames, cfg)
    return rounded.groupBy("session_id").agg(*[
        settled(F.max(F.when(F.col("feature") == b[0], F.col("median"))), 5).alias(b[0])
        for b in cfg.bands])


def sustained_strain(frames: DataFrame, cfg: Config) -> DataFrame:
    """Was the voice strained throughout a session, whatever was said?"""
    windows = trustworthy(frames, cfg).groupBy("session_id").agg(F.count("*").alias("windows"))
    rows = measurements(frames, ["session_id"], cfg)
    typical = grouped_median(rows, ["session_id", "feature"], "divergence", "zero", "one").drop("n")
    held = rows.groupBy("session_id", "feature").agg(F.avg(
        (F.round("divergence", 9) >= cfg.feature_divergence).cast("double")).alias("held"))
    parts = typical.join(held, ["session_id", "feature"]).filter(
        F.round("median", 9) >= cfg.feature_divergence)
    weight = band_bounds(cfg, F.col("feature"), 3)
    scored = parts.groupBy("session_id").agg(
        F.count("*").alias("features"),
        settled(F.sum(settled(F.col("median"), 3) * weight) / F.sum(weight), 4).alias("d"),
        settled(F.sum(F.col("held") * weight) / F.sum(weight), 4).alias("c"))
    out = windows.join(scored, "session_id", "left").withColumn(
        "features", F.coalesce("features", F.lit(0)))
    enough = F.col("windows") >= cfg.strain_windows
    several = F.col("features") >= cfg.strain_features
    reason = (
        F.when(~enough, F.concat(
            F.lit("windows("), F.col("windows").cast("string"), F.lit(f",{cfg.strain_windows})")))
        .when(~several, F.concat(
            F.lit("features("), F.col("features").cast("string"), F.lit(f",{cfg.strain_features})")))
        .when(F.col("d") < cfg.strain_divergence, F.concat(
            F.lit("divergence("), fixed(F.col("d"), 2), F.lit(f",{cfg.strain_divergence})")))
        .when(F.col("c") < cfg.strain_coverage, F.concat(
            F.lit("coverage("), F.rint(F.round(F.col("c") * 100, 9)).cast("bigint").cast("string"),
            F.lit(f"%,{cfg.strain_coverage:.0%})")))
        .otherwise("strain"))
    shown = enough & several
    return out.select(
        "session_id", "windows", F.when(enough, F.col("features")).otherwise(0).alias("features"),
        F.when(shown, F.col("d")).otherwise(0.0).alias("divergence"),
        F.when(shown, F.col("c")).otherwise(0.0).alias("coverage"), reason.alias("reason"),
        (reason == "strain").alias("raised"),
        severity(F.when(shown, F.col("d")).otherwise(0.0), 0.50).alias("severity"))


# ------------------------------------------------------------------ change over time ---
def voice_baseline(history: DataFrame, cfg: Config) -> DataFrame:
    """history: (pid, session_id, feature, value) of prior sittings -> centre and robust spread."""
    normal, notable = (band_bounds(cfg, F.col("feature"), i) for i in (1, 2))
    low, high = F.least(normal, notable), F.greatest(normal, notable)
    rows = history.filter("value IS NOT NULL").withColumns({
        "low": low - 3 * (high - low), "high": high + 3 * (high - low)})
    # read by the spread and again by the result: written once
    centre = materialised(grouped_median(rows, ["pid", "feature"], "value", "low", "high"),
                          "voice-centre")
    away = rows.join(centre, ["pid", "feature"]).withColumns({
        "off": F.abs(F.col("value") - F.col("median")), "zero": F.lit(0.0),
        "span": F.col("high") - F.col("low")})
    mad = grouped_median(away, ["pid", "feature"], "off", "zero", "span").select(
        "pid", "feature", F.col("median").alias("mad"))
    sittings = history.groupBy("pid").agg(F.count_distinct("session_id").alias("sessions"))
    return centre.filter("n >= 2").join(mad, ["pid", "feature"]).join(sittings, "pid").select(
        "pid", "feature", "sessions", F.col("median").alias("centre"),
        F.greatest(F.col("mad") * MAD_SCALE, F.abs("median") * 0.05, F.lit(1e-6)).alias("spread"))


def baseline_shift(current: DataFrame, baseline: DataFrame, cfg: Config) -> DataFrame:
    """current: (pid, session_id, feature, value) -> has this voice left its own history?

    Only moves toward the notable end of a band count.
    """
    joined = current.join(baseline, ["pid", "feature"], "left")
    toward = F.signum(band_bounds(cfg, F.col("feature"), 2) - band_bounds(cfg, F.col("feature"), 1))
    z = (F.col("value") - F.col("centre")) / F.col("spread")
    usable = F.coalesce(F.col("sessions") >= cfg.shift_sessions, F.lit(False))
    moved = usable & F.coalesce(F.round(z * toward, 9) >= cfg.shift_z, F.lit(False))
    counts = joined.groupBy("pid", "session_id").agg(
        F.count_if(moved).alias("shifted"), F.coalesce(F.max("sessions"), F.lit(0)).alias("history"))
    enough = F.col("history") >= cfg.shift_sessions
    raised = enough & (F.col("shifted") >= cfg.shift_features)
    return counts.select(
        "pid", "session_id", "shifted", "history", raised.alias("raised"),
        F.when(~enough, F.concat(
            F.lit("history("), F.col("history").cast("string"), F.lit(f",{cfg.shift_sessions})")))
        .when(~raised, F.concat(
            F.lit("features("), F.col("shifted").cast("string"), F.lit(f",{cfg.shift_features})")))
        .otherwise("shift").alias("reason"))


def split_history(sittings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sittings: (pid, session_id, feature, value) -> the latest sitting and everything before."""
    last = sittings.groupBy("pid").agg(F.max("session_id").alias("_last"))
    marked = sittings.join(last, "pid")
    return (marked.filter("session_id = _last").drop("_last"),
            marked.filter("session_id < _last").drop("_last"))


# -------------------------------------------------------------- into the gate engine ---
def as_deviation(gaps: DataFrame, strain: DataFrame, shift: DataFrame, cfg: Config) -> DataFrame:
    """At most one ``voice`` deviation per session, in the shape of a screening deviation."""
    claims = gaps.groupBy("session_id").agg(
        F.count("*").alias("assessed"), F.count_if("raised").alias("gaps"),
        F.avg(F.when(F.col("raised"), F.col("divergence"))).alias("gap_strength"))
    out = (strain.select("session_id", F.col("raised").alias("strained"),
                         F.col("divergence").alias("strain"), "coverage")
           .join(claims, "session_id", "full")
           .join(shift.select("session_id", F.col("raised").alias("moved"), "shifted"),
                 "session_id", "full"))
    gap = F.coalesce(F.col("gaps"), F.lit(0)) > 0
    strained = F.coalesce("strained", F.lit(False))
    moved = F.coalesce("moved", F.lit(False))
    anchored = gap & (F.col("assessed") >= cfg.gap_assessments)
    rate = (F.when(anchored, F.col("gaps") / F.col("assessed"))
            .when(strained, F.col("coverage")).otherwise(0.5))
    value = F.least(F.lit(1.0), F.when(
        anchored, F.col("gaps") / F.col("assessed") * F.col("gap_strength") * 2.0)
        .when(strained, F.col("strain") * F.col("coverage"))
        .otherwise(0.10 * F.coalesce("shifted", F.lit(0))))
    z = value / UNIT_STDEV
    tier = cfg.domain_tier.get("voice", "T3")
    return out.filter(gap | strained | moved).select(
        "session_id", F.lit("voice").alias("domain"), settled(z, 4).alias("z_self"),
        settled(z * 0.8, 4).alias("z_unit"), F.lit("elevated").alias("direction"),
        F.lit(1).cast("bigint").alias("windows_breached"), F.lit(tier).alias("tier"),
        F.lit(float(cfg.tier_weight[tier])).alias("weight"), settled(rate, 4).alias("breach_0"),
        F.lit(0.0).alias("breach_1"), F.lit(0.0).alias("breach_2"), F.lit(0.0).alias("missing"))


def sessions_by_gap(frames: DataFrame, idle_ms: int, width: int = DAY_MS) -> DataFrame:
    """Cut a person's frames into sittings wherever they were silent for longer than ``idle_ms``."""
    near = lagged(frames, ["pid"], "at_ms", "at_ms", "_before", width)
    fresh = F.coalesce(F.col("at_ms") - F.col("_before") > idle_ms, F.lit(True)).cast("bigint")
    return running(near, ["pid"], "at_ms", {"sitting": ("sum", fresh)}, width).drop("_before")
