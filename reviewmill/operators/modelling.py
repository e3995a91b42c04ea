"""Label encoding, stratified splits, batch scoring, stacking and the meta model."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from reviewmill import fixed
from reviewmill.functions import keys, vectors
from reviewmill.operators import numbering
from reviewmill.sources import files

# A cell of the split histogram holds about so many rows.
CELL_ROWS = 5_000
# Labels that are put in order on the driver; more are put in order by ranges.
FEW_LABELS = 1_000


def class_names(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct class names; missing labels are no class."""
    return df.select(F.col(label).cast("string").alias("name")).where("name IS NOT NULL").distinct()


def class_encode(df: DataFrame, label: str = "label", out: str = "label_id") -> DataFrame:
    """Number the classes 0.. in text order; a missing label has no number.

    The classes are numbered by ranges, whatever their number, and written; the
    planner knows the size of that table and chooses the join.
    """
    numbers = numbering.numbered(class_names(df, label), "name", out="_class")
    numbers = files.stage(numbers.select(F.col("name").alias("_class_name"), "_class"), "classes")
    joined = df.join(numbers, F.col(label).cast("string") == F.col("_class_name"), "left")
    return joined.withColumn(out, F.col("_class").cast("int")).drop("_class", "_class_name")


def _split_hash(row_id: str, seed: int) -> Column:
    return F.md5(keys.seeded(F.col(row_id), seed))


def _mark(validation: Column) -> Column:
    return F.when(validation, F.lit("validation")).otherwise(F.lit("train"))


def _shared_out(spark: SparkSession, schema: StructType, counts: list, share: float) -> DataFrame:
    """(_cut_label, wanted) from the rows of each of a few labels."""
    exact = [Decimal(str(share)) * r["n"] for r in counts]
    more = math.ceil(sum(exact)) - sum(map(math.floor, exact))
    order = sorted(range(len(counts)), key=lambda i: (
        -(exact[i] - math.floor(exact[i])), counts[i]["_label"] is not None, counts[i]["_label"]))
    rows = [(counts[i]["_label"], math.floor(exact[i]) + (place < more)) for place, i in enumerate(order)]
    return spark.createDataFrame(rows, StructType([
        StructField("_cut_label", schema["_label"].dataType), StructField("wanted", LongType())]))


def _shared_out_by_ranges(counts: DataFrame, share: float) -> tuple[int, DataFrame]:
    """All rows, and (_cut_label, wanted), for any number of labels."""
    exact = F.lit(Decimal(str(share))) * F.col("n")
    counts = counts.withColumns({"floor": F.floor(exact).cast("bigint"), "rest": exact - F.floor(exact)})
    total, floors = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("floor"), F.lit(0))).first()
    more = math.ceil(Decimal(str(share)) * total) - floors
    by_rest = numbering.numbered(counts, F.col("rest").desc(), F.col("_label").asc_nulls_first())
    return total, files.stage(by_rest.select(
        F.col("_label").alias("_cut_label"),
        (F.col("floor") + (F.col("number") < more).cast("bigint")).alias("wanted")), "split-sizes")


def stratified_split(
    df: DataFrame, label: str = "label", row_id: str = "review_id",
    share: float = fixed.VALIDATION_SHARE, seed: int = fixed.SPLIT_SEED,
) -> DataFrame:
    """Add `split`: exactly ceil(share * n) rows go to validation, shared out by label.

    Each label gives the floor of its share, and the labels with the largest
    remainders one row more, ties in the order of the labels; a missing label is one of
    its own.  Of a label the rows with the lowest seeded hash are taken.  Ranking all
    rows of a label would put a whole label into one task, so a histogram of the
    hash first finds the cell the last validation row lies in, and only that
    cell is ranked; cells are as narrow as the number of rows asks for.
    """
    rows = files.stage(df.select(
        F.col(label).alias("_label"), F.col(row_id).alias("_id"), _split_hash(row_id, seed).alias("_hash")),
        "split-hashes")
    counts = rows.groupBy("_label").agg(F.count("*").alias("n"))
    few = counts.limit(FEW_LABELS + 1).collect() if FEW_LABELS else []
    if few and len(few) <= FEW_LABELS:
        total, wanted = sum(r["n"] for r in few), _shared_out(df.sparkSession, counts.schema, few, share)
    else:
        total, wanted = _shared_out_by_ranges(counts, share)

    digits = max(1, math.ceil(math.log(max(total / CELL_ROWS, 1), 16)))
    cells = rows.withColumn("_cell", F.substring("_hash", 1, digits))
    so_far = Window.partitionBy("_label").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        cells.groupBy("_label", "_cell").agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(so_far))
        .join(wanted, F.col("_label").eqNullSafe(F.col("_cut_label")))
        .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        .select("_cut_label", F.col("_cell").alias("_cut_cell"),
                (F.col("wanted") - F.col("upto") + F.col("n")).alias("need"))
    )
    in_cell = cells.join(cut, F.col("_label").eqNullSafe(F.col("_cut_label"))
                         & (F.col("_cell") == F.col("_cut_cell")))
    order = Window.partitionBy("_label").orderBy("_hash", "_id")
    last = files.stage(
        in_cell.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == F.col("need"))
        .select("_label", F.struct("_hash", "_id").alias("_last")), "split-points")
    mine = F.struct(_split_hash(row_id, seed).alias("_hash"), F.col(row_id).alias("_id"))
    return (
        df.join(last, F.col(label).eqNullSafe(F.col("_label")), "left")
        .withColumn("split", _mark(F.col("_last").isNotNull() & (mine <= F.col("_last"))))
        .drop("_label", "_last")
    )


def hash_split(
    df: DataFrame, row_id: str = "review_id",
    share: float = fixed.VALIDATION_SHARE, seed: int = fixed.SPLIT_SEED,
) -> DataFrame:
    """Add `split` by hash alone: one projection, the share holding on average."""
    point = keys.hash_number(keys.seeded(F.col(row_id), seed)).cast("double") / 2.0**32
    return df.withColumn("split", _mark(point < share))


def with_logits(
    df: DataFrame, make_predict: Callable, text: str = "text", context: str = "poi",
    out: str = "logits", batch_size: int = fixed.SCORE_BATCH,
) -> DataFrame:
    """Score (text, context) with the caller's model.

    `make_predict()` loads the model once per Python worker and returns a
    function of two string arrays that gives one row of logits per review.
    """
    predict = predict_batch_udf(
        make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size
    )
    return df.withColumn(out, predict(text, context))


def with_probabilities(df: DataFrame, logits: str = "logits", out: str = "probs") -> DataFrame:
    return df.withColumn(out, vectors.softmax(F.col(logits)))


def with_prediction(df: DataFrame, scores: str = "logits", out: str = "prediction") -> DataFrame:
    return df.withColumn(out, vectors.argmax(F.col(scores)))


def stack_columns(
    df: DataFrame, left: str = "presence", right: str = "probs", out: str = "features"
) -> DataFrame:
    """Two array columns of one table side by side."""
    return df.withColumn(out, F.concat(F.col(left), F.col(right)))


def stack_features(
    words: DataFrame, probs: DataFrame, row_id: str = "review_id",
    left: str = "presence", right: str = "probs", out: str = "features",
) -> DataFrame:
    """Vocabulary vector and class probabilities side by side, matched by row id.

    Every review is kept; one without probabilities fails the query.
    """
    told = probs.select(F.col(row_id).alias("_told_id"), right)
    joined = words.join(told, F.col(row_id) == F.col("_told_id"), "left").drop("_told_id")
    missing = F.raise_error(F.concat(F.lit("no probabilities for row "), F.col(row_id).cast("string")))
    checked = F.when(F.col(right).isNull(), missing.cast("array<double>")).otherwise(F.col(right))
    return stack_columns(joined.withColumn(right, checked), left, right, out)


def train_meta(
    df: DataFrame, features: str = "features", label: str = "label_id",
    max_iter: int = fixed.META_MAX_ITER, staged: bool = True,
) -> LogisticRegressionModel:
    """Multinomial logistic regression with unit-strength L2 on the weights.

    The training table is written once, so that the passes of the optimiser do
    not recompute the features.
    """
    table = df.select(F.col(features), F.col(label).cast("double").alias(label))
    if staged:
        table = files.stage(table, "meta-training")
    table = table.withColumn(features, vectors.to_vector(F.col(features)))
    return LogisticRegression(
        featuresCol=features, labelCol=label, family="multinomial", maxIter=max_iter,
        regParam=1.0 / max(table.count(), 1), elasticNetParam=0.0, standardization=False,
    ).fit(table)


def predict_meta(
    model: LogisticRegressionModel, df: DataFrame, out: str = "prediction"
) -> DataFrame:
    """Class of the stacked model; the feature array stays an array."""
    features = model.getFeaturesCol()
    kept = [c for c in df.columns if c not in (features, out)]
    scored = model.transform(
        df.withColumn("_array", F.col(features))
        .withColumn(features, vectors.to_vector(F.col(features)))
    )
    return scored.select(
        *kept, F.col("_array").alias(features),
        F.col(model.getPredictionCol()).cast("int").alias(out),
    )


@dataclass(frozen=True)
class MetaModel:
    """The stacked model and the names of its classes, in the order of their ids."""

    model: LogisticRegressionModel
    classes: tuple[str, ...]


def trained_classes(df: DataFrame, label: str = "label", label_id: str = "label_id") -> tuple[str, ...]:
    """Names of the classes by id: as many as the model has rows of coefficients."""
    pairs = df.where(F.col(label_id).isNotNull()).select(label_id, F.col(label).cast("string")).distinct()
    return tuple(name for _, name in sorted(pairs.collect()))


def save_model(meta: MetaModel, spark: SparkSession, path: str) -> None:
    """Model and class names under one folder, replacing what is there."""
    meta.model.write().overwrite().save(f"{path}/model")
    names = spark.createDataFrame(list(enumerate(meta.classes)), "label_id int, name string")
    names.write.mode("overwrite").parquet(f"{path}/classes")


def load_model(spark: SparkSession, path: str) -> MetaModel:
    names = spark.read.parquet(f"{path}/classes").collect()
    return MetaModel(LogisticRegressionModel.load(f"{path}/model"), tuple(n for _, n in sorted(names)))
