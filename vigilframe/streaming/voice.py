"""Live sittings: claims meet the frames around them, and a sitting closes after silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.operators.voice import trustworthy


def claims_with_frames(utterances: DataFrame, frames: DataFrame, cfg: Config,
                       late_by: str = "10 minutes") -> DataFrame:
    """Interval join of two streams; both sides drop state once the window has passed.

    utterances: (session_id, utterance_id, said_at, cue, ...); frames: (session_id, heard_at, ...).
    The text itself is not carried: a transcript never reaches a sink.
    """
    gap = f"INTERVAL {cfg.gap_window_ms // 1000} SECONDS"
    said = utterances.drop("text").withWatermark("said_at", late_by).alias("u")
    heard = trustworthy(frames, cfg).withWatermark("heard_at", late_by).alias("f")
    near = F.expr(f"u.session_id = f.session_id AND f.heard_at >= u.said_at - {gap} "
                  f"AND f.heard_at <= u.said_at + {gap}")
    return said.join(heard, near).select(
        "u.session_id", "u.utterance_id", "u.said_at", "f.heard_at",
        *[F.col(f"f.{b[0]}") for b in cfg.bands])


def sittings(frames: DataFrame, cfg: Config, idle: str = "30 minutes",
             late_by: str = "10 minutes") -> DataFrame:
    """Medians of a sitting, emitted when its silence gap has passed the watermark."""
    heard = trustworthy(frames, cfg).withWatermark("heard_at", late_by)
    return heard.groupBy(F.session_window("heard_at", idle).alias("w"), "pid").agg(
        F.count("*").alias("windows"),
        *[F.percentile(b[0], F.lit(0.5)).alias(b[0]) for b in cfg.bands]).select(
        "pid", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "windows",
        *[F.round(b[0], 5).alias(b[0]) for b in cfg.bands])
