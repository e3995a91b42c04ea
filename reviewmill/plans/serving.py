"""The two-stage classifier as one saved object, from a review to the name of its class."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, functions as F

from reviewmill import fixed
from reviewmill.operators import modelling, quality, stages
from reviewmill.sources import files


def feature_stages(factory: str) -> list:
    """From the columns of a review to the vector of the meta model."""
    return [stages.Presence(), stages.Context(), stages.Scores(factory=factory), stages.Stacked()]


def train_pipeline(reviews: DataFrame, factory: str, max_iter: int = fixed.META_MAX_ITER) -> PipelineModel:
    """Fit the meta model on labelled reviews and put it behind the stages of its features.

    The features are written once and read by the passes of the optimiser.  Rows without a
    label are left out.
    """
    quality.require_columns(reviews, fixed.TRAINING_COLUMNS)
    made = PipelineModel(feature_stages(factory))
    encoded = modelling.class_encode(reviews.where("label IS NOT NULL"))
    with files.small_batches(reviews.sparkSession):
        table = files.stage(made.transform(encoded).select(
            "features", F.col("label_id").cast("double").alias("label_id"),
            F.col("label").cast("string").alias("label")), "pipeline-training")
    meta = LogisticRegression(
        featuresCol="features", labelCol="label_id", family="multinomial", maxIter=max_iter,
        regParam=1.0 / max(table.count(), 1), elasticNetParam=0.0, standardization=False).fit(table)
    names = stages.ClassNames(names=list(modelling.trained_classes(table)))
    return PipelineModel([*made.stages, meta, names])


def save_pipeline(pipeline: PipelineModel, path: str) -> None:
    """All stages with their parameters under one folder, replacing what is there."""
    pipeline.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classify(pipeline: PipelineModel, reviews: DataFrame) -> DataFrame:
    """The reviews with `prediction`, `label_name` and the probabilities of the classes as an array."""
    from pyspark.ml.functions import vector_to_array

    scored = pipeline.transform(reviews)
    return scored.select(*reviews.columns, "prediction", "label_name",
                         vector_to_array("probability").alias("class_probs"))
