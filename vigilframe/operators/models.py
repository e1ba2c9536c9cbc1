"""Boosted trees with isotonic calibration on MLlib.  A missing model never stops a run."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions.scalar import clamp
from vigilframe.operators.evaluation import stable_split
from vigilframe.session import materialised

HORIZON_DAYS = 60
# fewer rows are not worth a task of their own; with more, another round of tasks
LEAST_ROWS, MOST_ROWS = 20_000, 500_000


@dataclass(frozen=True)
class RiskModel:
    booster: PipelineModel
    calibrator: IsotonicRegressionModel
    version: str
    features: tuple[str, ...]

    @property
    def importances(self) -> dict[str, float]:
        weights = self.booster.stages[-1].featureImportances.toArray()
        return dict(zip(self.features, (float(w) for w in weights)))


def balanced(train: DataFrame) -> DataFrame:
    """Weight the rare class by neg/pos instead of resampling."""
    ratio = train.agg((F.count_if(F.col("label") == 0)
                       / F.greatest(F.lit(1), F.count_if(F.col("label") == 1))).alias("r")).scalar()
    return train.withColumn("weight", F.when(F.col("label") == 1, ratio).otherwise(1.0))


def parts_for(rows: int, slots: int) -> int:
    """As many parts as fill every slot a whole number of times; fewer where the rows are few."""
    return max(1, min(ceil(rows / LEAST_ROWS), slots * max(1, ceil(rows / (slots * MOST_ROWS)))))


def dealt(train: DataFrame, features: list[str]) -> DataFrame:
    """The rows in even parts and in one order, whatever files they came in.

    Every level of every tree is a job over these parts: a part more than there are slots is a second
    round in each of them.  The booster draws its samples along a part, so the order is settled too.
    """
    slots = train.sparkSession.sparkContext.defaultParallelism
    return train.repartition(parts_for(train.count(), slots), "pid").sortWithinPartitions(
        "pid", "label", *features)


def raw_score(scored: DataFrame) -> DataFrame:
    return scored.withColumn("raw", vector_to_array("probability")[1])


def fit(rows: DataFrame, features: list[str], version: str, *, seed: int = 26186,
        iterations: int = 180) -> tuple[RiskModel, DataFrame]:
    """rows: (pid, features..., label), a written table: it is read more than once.

    Returns the model and the scored held-out rows.
    """
    parts = stable_split(rows, "pid", seed)
    train = materialised(dealt(balanced(parts.filter("train")), features), "train")
    booster = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features"),
        GBTClassifier(maxIter=iterations, stepSize=0.05, maxDepth=3, minInstancesPerNode=12,
                      subsamplingRate=0.8, seed=seed, weightCol="weight", labelCol="label"),
    ]).fit(train)
    calibrator = IsotonicRegression(featuresCol="raw", labelCol="label").fit(
        raw_score(booster.transform(train)).select("raw", F.col("label").cast("double")))
    model = RiskModel(booster, calibrator, version, tuple(features))
    return model, score(model, parts.filter("NOT train"))


def score(model: RiskModel | None, rows: DataFrame) -> DataFrame:
    """Calibrated and clamped score, or an honest "unavailable" when there is no model."""
    if model is None:
        return rows.withColumns({"risk_score": F.lit(0.0), "risk_status": F.lit("unavailable"),
                                 "model_version": F.lit("unavailable")})
    out = model.calibrator.setPredictionCol("calibrated").transform(
        raw_score(model.booster.transform(rows)))
    usable = F.col("calibrated").isNotNull() & ~F.isnan("calibrated")
    return out.withColumns({
        "risk_score": F.when(usable, clamp(F.col("calibrated"))).otherwise(0.0),
        "risk_status": F.when(usable, "ok").otherwise("unavailable"),
        "model_version": F.lit(model.version),
    }).drop("features", "rawPrediction", "probability", "prediction", "raw", "calibrated")


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the files of a saved model: hashed in tasks, a short list is combined."""
    name = F.element_at(F.split("path", "/"), -1)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .filter(~name.startswith("_")))
    listed = files.select(F.concat_ws(":", F.substring_index(F.col("path"), path, -1), name,
                                      F.sha2("content", 256)).alias("line"))
    whole = listed.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256))
    return whole.first()[0]


def whole_digest(spark: SparkSession, path: str) -> str:
    return f"{digest(spark, f'{path}/booster')}-{digest(spark, f'{path}/calibrator')}"


def save(model: RiskModel, spark: SparkSession, path: str) -> str:
    model.booster.write().overwrite().save(f"{path}/booster")
    model.calibrator.write().overwrite().save(f"{path}/calibrator")
    mark = whole_digest(spark, path)
    card = spark.range(1).select(F.lit(model.version).alias("version"), F.lit(mark).alias("digest"),
                                 F.array(*[F.lit(f) for f in model.features]).alias("features"))
    card.write.mode("overwrite").json(f"{path}/card")
    return mark


def load(spark: SparkSession, path: str) -> RiskModel | None:
    """The saved model, or None when it is missing or no longer matches its card."""
    try:
        card = spark.read.schema("version STRING, digest STRING, features ARRAY<STRING>").json(
            f"{path}/card").first()
        if card is None or whole_digest(spark, path) != card.digest:
            return None
        return RiskModel(PipelineModel.load(f"{path}/booster"),
                         IsotonicRegressionModel.load(f"{path}/calibrator"),
                         card.version, tuple(card.features))
    except Exception:  # a model that cannot be read is a model that is absent
        return None
