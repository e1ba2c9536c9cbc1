"""Queries about words and voice, over ``conversations``, ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.config import CLAUSE_BREAK, Config
from vigilframe.operators import voice
from vigilframe.plans.registry import Registry, joined, r9
from vigilframe.session import materialised
from vigilframe.sources import tables as T

QUERIES = Registry()
DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS

# The texts are invented prose in four languages, so frequent words stand in for the cue bank.
CFG = Config().but(
    cues=((r"\bof (the|a)\b", "wellbeing", 0.80), (r"\bis\b", "dismissal", 0.70),
          (r"\bde la\b", "coping", 0.66), (r"\bthe\b", "normalising", 0.62),
          (r"\bund\b", "attribution", 0.30)),
    hedges=("that", "der "), contrasts=("and", "la"), negators=("to", "en", "pas"),
    acute_phrases=(r"\bof the\b", r"\bin (a|der)\b", r"\bde l(a|os)\b", r"\bthe .* the\b"),
    gap_window_ms=2 * DAY_MS)
BREAKS = CLAUSE_BREAK.replace("but", "with")


def utterances(spark, folder):
    """conversations -> what was said, four days apart per turn, in weekly sessions."""
    at = F.col("turn") * 4 * DAY_MS + F.col("turn") * 3_600_000
    return T.read(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("utterance_id"),
        F.concat_ws("-", F.col("conv_id"), F.floor(at / WEEK_MS)).alias("session_id"),
        at.alias("at_ms"), "text")


def frames(spark, folder):
    """events -> acoustic windows: the amount drives every feature, some are missing by type."""
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.least(F.lit(1.0), F.col("value") / 50)
    kind = F.col("event_type")
    at = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    return T.read(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("pid"),
        F.concat_ws("-", F.col("user_id"), F.floor(at / WEEK_MS)).alias("session_id"),
        at.alias("at_ms"), (0.3 + k / 50).alias("duration_s"), (k / 100).alias("voiced_fraction"),
        (0.005 + 0.035 * v).alias("jitter_local"),
        F.when(kind != "signup", 0.03 + 0.1 * v).alias("shimmer_local"),
        F.when(kind != "error", 20 - 14 * v).alias("hnr_db"),
        (9 - 7 * v).alias("f0_range_semitones"),
        F.when(kind != "view", 0.2 + 0.6 * v).alias("pause_ratio"),
        (4 - 2.4 * v).alias("speech_rate_sps"))


PUBLISHED = Config()
#: sentences that hold, negate, hedge and contrast the published cues, and acute ones, put before what was said
PLANTED = (
    "Honestly, I'm fine.", "i'm okay, mostly", "I am not saying it but I'm alright", "Nothing much, though tired.",
    "it's nothing", "No problem at all.", "I'm managing. More or less", "we never hear it: i'll cope",
    "i'll be fine", "getting by, I suppose", "Hardly used to it", "used to it by now", "It is part of the job",
    "everybody goes through that", "just a bit tired", "not a big deal", "It is hardly a thing, not big deal",
    "don't worry, I'm fine but I'm okay", "I'll sorted it", "i'll be sort it", "far from it: I'm fine",
    "i can't go on", "they are better off without me", "No point going on, no reason in living", "a plain day", "",
    "I want to die; I will end it all")


def planted(spark, folder):
    """conversations with a sentence before every turn, chosen by the place of the turn."""
    sentence = F.element_at(F.array(*[F.lit(x) for x in PLANTED]), (
        (F.col("conv_id") * 7 + F.col("turn") * 5) % len(PLANTED) + 1).cast("int"))
    return T.read(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("utterance_id"),
        F.concat(sentence, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


@QUERIES.query
def published_cues(spark, folder):
    """Every cue of the published bank that is not negated."""
    rows = planted(spark, folder).select("utterance_id", F.inline(voice.cues("text", PUBLISHED, CLAUSE_BREAK)))
    return rows.select("utterance_id", F.col("start").cast("bigint").alias("start"), "phrase", "kind", "confidence")


@QUERIES.query
def published_acute(spark, folder):
    """The published acute phrases heard in every turn."""
    heard = planted(spark, folder).select("utterance_id", voice.acute_phrases(F.col("text"), PUBLISHED).alias("heard"))
    return heard.filter(F.size("heard") > 0).select("utterance_id", joined("heard", " + "))


def claims(spark, folder):
    return voice.best_cue(utterances(spark, folder), CFG, BREAKS)


@QUERIES.query
def cue_counts(spark, folder):
    """Every cue of every utterance that is not negated."""
    rows = utterances(spark, folder).select(
        "utterance_id", F.inline(voice.cues("text", CFG, BREAKS)))
    return rows.select("utterance_id", F.col("start").cast("bigint").alias("start"), "phrase",
                       "kind", "confidence")


@QUERIES.query
def cue_best(spark, folder):
    return claims(spark, folder).select(
        "utterance_id", F.col("cue.start").cast("bigint").alias("start"),
        F.col("cue.phrase").alias("phrase"), F.col("cue.kind").alias("kind"),
        F.col("cue.confidence").alias("confidence"))


@QUERIES.query
def acute_phrases(spark, folder):
    """Literal patterns heard in whole documents."""
    heard = T.read(spark, folder, "documents").select(
        "doc_id", voice.acute_phrases(F.col("text"), CFG).alias("heard"))
    return heard.filter(F.size("heard") > 0).select("doc_id", joined("heard", " + "))


@QUERIES.query
def frame_divergence(spark, folder):
    """How far each feature lies outside its band, over trustworthy frames."""
    rows = voice.measurements(frames(spark, folder), ["session_id"], CFG)
    return rows.groupBy("session_id", "feature").agg(
        F.count("*").alias("n"), F.avg("divergence").alias("divergence")).select(
        "session_id", "feature", "n", r9("divergence"))


@QUERIES.query
def utterance_frames(spark, folder):
    """Interval join: trustworthy frames around every claim."""
    said = claims(spark, folder).select(
        "session_id", "utterance_id", "at_ms")
    near = voice.frames_near(said, voice.trustworthy(frames(spark, folder), CFG), CFG)
    return near.groupBy("utterance_id").agg(
        F.count("*").alias("frames"), F.min(F.col("at_ms") - F.col("said_at")).alias("first"),
        F.max(F.col("at_ms") - F.col("said_at")).alias("last"))


def gaps(spark, folder):
    return voice.gap_assessments(claims(spark, folder), frames(spark, folder), CFG)


@QUERIES.query
def concordance_gaps(spark, folder):
    return gaps(spark, folder).select(
        "utterance_id", "raised", r9("divergence"), "severity", "features", "reason")


@QUERIES.query
def session_summaries(spark, folder):
    return voice.summaries(frames(spark, folder), CFG)


@QUERIES.query
def sustained_strain(spark, folder):
    return voice.sustained_strain(frames(spark, folder), CFG).select(
        "session_id", "windows", "features", r9("divergence"), r9("coverage"), "raised",
        "severity", "reason")


def sittings(spark, folder):
    """Session medians per person, as the history keeps them."""
    medians = voice.session_medians(frames(spark, folder), CFG)
    kept = medians.select(
        F.substring_index("session_id", "-", 1).alias("pid"), "session_id", "feature",
        F.round(F.round("median", 10), 5).alias("value"))
    return materialised(kept, "sittings")


@QUERIES.query
def voice_baselines(spark, folder):
    _, history = voice.split_history(sittings(spark, folder))
    return voice.voice_baseline(history, CFG).select(
        "pid", "feature", "sessions", r9("centre"), r9("spread"))


def shifts(spark, folder):
    current, history = voice.split_history(sittings(spark, folder))
    return voice.baseline_shift(current, voice.voice_baseline(history, CFG), CFG)


@QUERIES.query
def baseline_shifts(spark, folder):
    return shifts(spark, folder).select("pid", "session_id", "shifted", "history", "raised",
                                        "reason")


@QUERIES.query
def voice_deviations(spark, folder):
    """What a sitting contributes to a case: one T3 deviation, or nothing."""
    strain = voice.sustained_strain(frames(spark, folder), CFG)
    return voice.as_deviation(gaps(spark, folder), strain, shifts(spark, folder), CFG).select(
        "session_id", "domain", r9("z_self"), r9("z_unit"), "tier", "weight", r9("breach_0"))


@QUERIES.query
def sittings_by_silence(spark, folder):
    """Sittings cut at three days of silence."""
    cut = voice.sessions_by_gap(frames(spark, folder).select("pid", "at_ms"), 3 * DAY_MS)
    return cut.groupBy("pid", "sitting").agg(
        F.count("*").alias("frames"), F.min("at_ms").alias("first"), F.max("at_ms").alias("last"))
