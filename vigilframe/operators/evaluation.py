"""How well a score ranks, calibrates and holds across subgroups.

Ranks are global, but no step sorts the population in one task: scores are first counted per
distinct value, cut into a fixed number of buckets, and only bucket totals (at most ``BUCKETS`` rows
per group) are accumulated in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.scalar import settled

BUCKETS = 4096
MIN_GROUP = 5
MIN_POSITIVES = 3
AGE_BANDS = ((30, "under-30"), (40, "30-39"))


def age_band(age: Column) -> Column:
    out = F.when(age < AGE_BANDS[0][0], AGE_BANDS[0][1])
    for limit, name in AGE_BANDS[1:]:
        out = out.when(age < limit, name)
    return out.otherwise("40-plus")


def stable_split(rows: DataFrame, key: str, seed: int, share: float = 0.7) -> DataFrame:
    """Train flag from a hash of the key: the same row lands on the same side in every run."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000)) / 1000.0
    return rows.withColumn("train", draw < share)


def auroc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum area under the curve, ties at average rank; .5 when one class is missing."""
    keys = list(by) or ["_all"]
    rows = scored if by else scored.withColumn("_all", F.lit(0))
    per_score = rows.groupBy(*keys, "score").agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"))
    per_score = per_score.withColumn("bucket", F.floor(F.col("score") * BUCKETS))
    totals = per_score.groupBy(*keys, "bucket").agg(F.sum("neg").alias("bucket_neg"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = totals.select(*keys, "bucket",
                          F.coalesce(F.sum("bucket_neg").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = per_score.withColumn("inside", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    joined = ranked.join(below, [*keys, "bucket"])
    out = joined.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / 2)).alias("wins"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    area = F.when((F.col("positives") == 0) | (F.col("negatives") == 0), 0.5).otherwise(
        F.col("wins") / (F.col("positives") * F.col("negatives")))
    return out.select(*by, "positives", "negatives", area.alias("auroc"))


def precision_recall(threshold: Column) -> tuple[Column, Column]:
    """Aggregates over (score, label); 0 where the ratio is undefined."""
    hit, truth = F.round("score", 9) >= F.round(threshold, 9), F.col("label") == 1
    tp, flagged, actual = F.count_if(hit & truth), F.count_if(hit), F.count_if(truth)
    return (F.coalesce(F.try_divide(tp, flagged), F.lit(0.0)),
            F.coalesce(F.try_divide(tp, actual), F.lit(0.0)))


def threshold_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at .01 .. .99 in one pass: scores fall into 100 levels, which are
    then accumulated from the top (99 rows)."""
    spark: SparkSession = scored.sparkSession
    level = F.least(F.lit(99), F.floor(F.round(F.col("score") * 100, 9)))
    levels = scored.groupBy(level.alias("level")).agg(
        F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos"))
    steps = spark.range(0, 100).withColumnRenamed("id", "level")
    full = F.broadcast(steps).join(levels, "level", "left").na.fill(0)
    down = Window.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.col("level").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    curve = full.select("level", F.sum("n").over(down).alias("flagged"),
                        F.sum("pos").over(down).alias("tp"), F.sum("pos").over(whole).alias("actual"))
    return curve.filter("level > 0").select(
        (F.col("level") / 100).alias("threshold"), "flagged", "tp",
        F.coalesce(F.try_divide("tp", "flagged"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "actual"), F.lit(0.0)).alias("recall"))


def select_threshold(curve: DataFrame, target: float) -> DataFrame:
    """Best recall at the target precision (highest threshold on ties), else the most precise."""
    point = F.struct("threshold", "precision", "recall")
    good = (F.round("precision", 9) >= target) & (F.col("recall") > 0)
    best = F.max_by(F.when(good, point), F.when(good, F.struct("recall", "threshold")))
    precise = F.col("precision") > 0
    fallback = F.max_by(F.when(precise, point),
                        F.when(precise, F.struct("precision", "threshold")))
    nothing = F.struct(F.lit(1.0).alias("threshold"), F.lit(0.0).alias("precision"),
                       F.lit(0.0).alias("recall"))
    return curve.agg(F.coalesce(best, fallback, nothing).alias("p")).select("p.*")


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    slot = F.least(F.lit(bins - 1), F.floor(F.round(F.col("score") * bins, 9)))
    per_bin = scored.groupBy(slot.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("score").alias("claimed"),
        F.sum(F.col("label").cast("double")).alias("true"))
    gap = F.sum(F.abs(F.col("claimed") - F.col("true"))) / F.sum("n")
    return per_bin.agg(settled(gap, 4).alias("ece"))


def subgroup_metrics(scored: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """n, positives, rate, AUROC, precision and recall per (key, value) of at least five people."""
    long = scored.unpivot(["pid", "score", "label"], list(keys), "key", "value")
    p, r = precision_recall(F.lit(threshold))
    counts = long.groupBy("key", "value").agg(
        F.count("*").alias("n"), p.alias("precision"), r.alias("recall"))
    areas = auroc(long, ["key", "value"])
    return counts.filter(F.col("n") >= MIN_GROUP).join(areas, ["key", "value"]).select(
        "key", "value", "n", "positives",
        settled(F.col("positives") / F.col("n"), 4).alias("positive_rate"),
        settled(F.col("auroc"), 4).alias("auroc"), settled(F.col("precision"), 4).alias("precision"),
        settled(F.col("recall"), 4).alias("recall"),
        (F.col("positives") >= MIN_POSITIVES).alias("measured"))


def widest_gap(metrics: DataFrame) -> DataFrame:
    area = F.when(F.col("measured"), F.col("auroc"))
    return metrics.agg((F.max(area) - F.min(area)).alias("gap"),
                       F.count_if("measured").alias("measured"), F.count("*").alias("subgroups"))


def top_drivers(features: DataFrame, importances: dict[str, float], cfg: Config,
                top: int = 3) -> DataFrame:
    """Largest importance x value contributions of a row; ties keep feature order."""
    entries = []
    for order, (name, weight) in enumerate(importances.items()):
        value = F.col(name) * weight
        entries.append(F.struct((-F.abs(value)).alias("key"), F.lit(order).alias("position"),
                                F.lit(name).alias("feature"), value.alias("value")))
    ranked = F.slice(F.array_sort(F.array(*entries)), 1, top)
    return features.select("pid", F.transform(ranked, lambda e: F.struct(
        e["feature"].alias("feature"), settled(e["value"], 5).alias("contribution"))
    ).alias("drivers"))


def hazard_horizons(rows: DataFrame, hazard: str, horizons: Sequence[int]) -> DataFrame:
    """Risk by when: per-interval hazard composed over each horizon."""
    first, last = min(horizons), max(horizons)
    h = F.least(F.lit(0.95), F.greatest(F.lit(1e-4), F.col(hazard)))
    by = {f"risk_{d}d": settled(1.0 - F.pow(1.0 - h, F.lit(d / first)), 4) for d in horizons}
    days = first * F.log(F.lit(0.5)) / F.log(1.0 - h)
    out = rows.withColumns(by)
    reached = [F.when(F.col(f"risk_{d}d") >= 0.5, F.lit(d)) for d in sorted(horizons)]
    soonest = F.coalesce(*reached)
    return out.withColumns({
        "median_days": F.when(days <= last, F.rint(days).cast("bigint")),
        "soonest": soonest.cast("bigint"),
        "phrase": F.when(soonest.isNull(), F.lit(
            f"the modelled hazard does not reach an even chance within {last} days")).otherwise(
            F.concat(F.lit("the modelled hazard reaches an even chance within "),
                     soonest.cast("string"), F.lit(" days"))),
    })
