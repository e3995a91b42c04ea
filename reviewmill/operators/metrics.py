"""Confusion matrix, macro metrics and the per-class report.

Only the confusion matrix reads the predictions; it is counted before the
shuffle and has (number of classes)^2 rows, and the rest works on that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill import fixed


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction"):
    """Long form: (label, prediction, n); rows without a label or a prediction are left out.

    They are left out by their count: a filter on the prediction would be moved in front of it, and compute it twice.
    """
    known = F.col(label).isNotNull() & F.col(prediction).isNotNull()
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.when(known, 1)).alias("n")
    ).where("n > 0")


def _ratio(top, bottom):
    """Division that gives 0 where nothing was counted."""
    return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0))).otherwise(0.0)


def class_scores(confusion: DataFrame) -> DataFrame:
    """Per class: precision, recall, f1, support; classes seen on either side."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 zero.alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"),
                 F.col("n").alias("predicted"), zero.alias("hits")),
    ))
    totals = confusion.select(sides.alias("s")).groupBy("s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"),
        F.sum("s.hits").alias("hits"),
    )
    return totals.select(
        "class", "support", "hits",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def macro_metrics(confusion: DataFrame) -> DataFrame:
    """One row: accuracy and unweighted means over the classes."""
    return class_scores(confusion).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def classification_report(confusion: DataFrame, digits: int = 4) -> DataFrame:
    """Rows per class, then accuracy, macro average and support-weighted average."""
    scores = class_scores(confusion)
    names = ("precision", "recall", "f1")
    per_class = scores.select(F.col("class").cast("string").alias("row"), *names, "support")
    weighted = [(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in names]
    accuracy = F.sum("hits") / F.sum("support")
    support = F.sum("support").alias("support")
    report = (
        per_class
        .union(scores.agg(*(accuracy.alias(m) for m in names), support)
               .select(F.lit("accuracy"), *names, "support"))
        .union(scores.agg(*(F.avg(m).alias(m) for m in names), support)
               .select(F.lit("macro avg"), *names, "support"))
        .union(scores.agg(*weighted, support).select(F.lit("weighted avg"), *names, "support"))
    )
    return report.select("row", *(F.round(m, digits).alias(m) for m in names), "support")


def label_dimension(spark: SparkSession, names=fixed.LABEL_NAMES) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "label int, label_name string")


def with_label_name(df: DataFrame, label: str = "label", names=fixed.LABEL_NAMES) -> DataFrame:
    """Add `label_name`; an unknown label gets null."""
    dimension = label_dimension(df.sparkSession, names).withColumnRenamed("label", label)
    return df.join(dimension, label, "left")


def with_label_id(
    df: DataFrame, name: str = "label_name", out: str = "label", names=fixed.LABEL_NAMES
) -> DataFrame:
    """Add the label id of a label name."""
    dimension = label_dimension(df.sparkSession, names).toDF(out, name)
    return df.join(dimension, name, "left")
