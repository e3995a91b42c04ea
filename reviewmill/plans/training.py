"""Two-stage classifier: features, stacked training, evaluation and inference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from reviewmill import fixed
from reviewmill.functions import text
from reviewmill.operators import features, metrics, modelling, quality
from reviewmill.sources import files


def feature_table(reviews: DataFrame, make_predict: Callable) -> DataFrame:
    """Reviews with `presence`, `probs` and the stacked `features`.

    Both halves come from the same row, so nothing has to be joined; use
    `modelling.stack_features` where the probabilities come as a table.
    """
    pairs = features.with_poi(features.with_presence(reviews)).withColumn(
        "_text", text.strip(F.coalesce("text", F.lit("")))
    )
    logits = modelling.with_logits(pairs, make_predict, text="_text").drop("_text")
    return modelling.stack_columns(modelling.with_probabilities(logits))


def prepared(reviews: DataFrame, make_predict: Callable, exact_split: bool = True) -> DataFrame:
    """Reviews with label ids, split and features.

    The encoded reviews are written once: splits, features and class names read them.
    """
    quality.require_columns(reviews, fixed.TRAINING_COLUMNS)
    encoded = files.stage(modelling.class_encode(reviews), "encoded-reviews")
    split = modelling.stratified_split if exact_split else modelling.hash_split
    return feature_table(split(encoded), make_predict)


def train(reviews: DataFrame, make_predict: Callable, exact_split: bool = True):
    """Fit the meta model on the training part; returns (meta model, scored validation)."""
    table = prepared(reviews, make_predict, exact_split)
    meta = fit(table)
    return meta, modelling.predict_meta(meta.model, table.where("split = 'validation'"))


def fit(table: DataFrame) -> modelling.MetaModel:
    """The meta model of the training part of a prepared table."""
    model = modelling.train_meta(table.where("split = 'train'"))
    return modelling.MetaModel(model, modelling.trained_classes(table))


def evaluate(scored: DataFrame) -> DataFrame:
    """Classification report of scored reviews.

    The counts are written: the rows of the report read them several times, and the reviews are scored once.
    """
    counts = files.stage(metrics.confusion_matrix(scored, "label_id"), "confusion")
    return metrics.classification_report(counts)


def infer(reviews: DataFrame, make_predict: Callable, meta: modelling.MetaModel) -> DataFrame:
    """New reviews to class ids and the names that the classes had in training."""
    scored = modelling.predict_meta(meta.model, feature_table(reviews, make_predict))
    return metrics.with_label_name(scored, "prediction", names=dict(enumerate(meta.classes)))
