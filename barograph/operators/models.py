"""Training, scoring and checking of the upside and risk models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barograph.schemas import FEATURE_COLUMNS


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="_features", handleInvalid="error")


# fixed values: sizes of the two boosted-tree models
def fit_upside(train: DataFrame, trees: int = 200, depth: int = 6, rate: float = 0.02) -> PipelineModel:
    tree = GBTRegressor(featuresCol="_features", labelCol="label_upside", predictionCol="pred_a", maxIter=trees,
                        maxDepth=depth, stepSize=rate, seed=42)
    return Pipeline(stages=[_assembler(), tree]).fit(train)


def class_weights(train: DataFrame, label: str = "label_risk") -> DataFrame:
    """Weight positives by negatives over positives, in one plan."""
    ratio = train.agg(F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1)
                                   .cast("double")).alias("_ratio"))
    return (train.crossJoin(F.broadcast(ratio))
            .withColumn("weight", F.when(F.col(label) == 1, F.coalesce("_ratio", F.lit(1.0))).otherwise(1.0)).drop("_ratio"))


def fit_risk(train: DataFrame, trees: int = 150, depth: int = 5, rate: float = 0.03) -> PipelineModel:
    tree = GBTClassifier(featuresCol="_features", labelCol="label_risk", predictionCol="_class",
                         weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, seed=42)
    return Pipeline(stages=[_assembler(), tree]).fit(class_weights(train))


def score(features: DataFrame, upside: PipelineModel, risk: PipelineModel | None = None) -> DataFrame:
    """``pred_a``, ``risk_prob`` (null without a risk model) and ``final_score``."""
    rows = upside.transform(features).drop("_features")
    if risk is None:
        rows = rows.withColumn("risk_prob", F.lit(None).cast("double"))
    else:
        rows = risk.transform(rows).withColumn("risk_prob", vector_to_array("probability")[1]).drop(
            "_features", "probability", "rawPrediction", "_class")
    return final_score(rows)


def final_score(rows: DataFrame) -> DataFrame:
    return rows.withColumn("final_score", F.col("pred_a") * (1 - F.coalesce("risk_prob", F.lit(0.0))))


def importances(spark: SparkSession, model: PipelineModel, name: str) -> DataFrame:
    """Features with their importance, largest first; as long as the feature contract."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, f, float(v)) for f, v in zip(FEATURE_COLUMNS, values)]
    return spark.createDataFrame(rows, "model string, feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def model_version(upside: str, risk: str | None = None) -> str:
    return f"{upside}+{risk}" if risk else upside


def contract_faults() -> dict[str, Column]:
    """Counts of all scores and of those outside the output contract; for ``agg`` or ``observe``."""
    bad = F.col("pred_a").isNull() | F.isnan("pred_a") | (F.abs("pred_a") == float("inf"))
    out = F.col("risk_prob").isNotNull() & (F.isnan("risk_prob") | ~F.col("risk_prob").between(0, 1))
    return {"rows": F.count(F.lit(1)), "bad_upside": F.count_if(bad), "bad_risk": F.count_if(out)}


def output_faults(rows: DataFrame) -> DataFrame:
    """One row with the number of scores outside the output contract."""
    return rows.agg(*[c.alias(n) for n, c in contract_faults().items()])


def require_contract(found: Mapping) -> None:
    if found["bad_upside"] or found["bad_risk"]:
        raise ValueError(f"model output breaks its contract: {dict(found)}")


def check_output(rows: DataFrame) -> DataFrame:
    require_contract(output_faults(rows).first().asDict())
    return rows
