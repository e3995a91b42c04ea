"""The features and the models as pipeline stages, which are saved and loaded with all they need."""

from __future__ import annotations

import importlib
import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from reviewmill import fixed
from reviewmill.functions import text, vectors
from reviewmill.operators import features, metrics, modelling


class _Saved(DefaultParamsReadable, DefaultParamsWritable):
    """Kept as its parameters."""


class _HasVocabulary(Params):
    vocabulary = Param(Params._dummy(), "vocabulary", "words in the order of the vector",
                       TypeConverters.toListString)


class Presence(Transformer, HasInputCol, HasOutputCol, _HasVocabulary, _Saved):
    """Which words of the vocabulary a text holds, as an array of 0 and 1."""

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="presence", vocabulary=None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="presence", vocabulary=list(fixed.VOCABULARY))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        words = self.getOrDefault(self.vocabulary)
        hits = vectors.vocabulary_hits(F.col(self.getInputCol()), words)
        return df.withColumn("_hits", hits).withColumn(
            self.getOutputCol(), vectors.presence(F.col("_hits"), words)).drop("_hits")


class Context(Transformer, HasOutputCol, _Saved):
    """The context string of a review, from its company, category and stars."""

    @keyword_only
    def __init__(self, *, outputCol="poi"):
        super().__init__()
        self._setDefault(outputCol="poi")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        poi = text.poi(F.col("company_name"), F.col("category"), F.col("stars"))
        return df.withColumn(self.getOutputCol(), poi)


class Scores(Transformer, HasInputCols, HasOutputCol, _Saved):
    """Class probabilities by the caller's model from a text and its context.

    The model is named, not kept: `package.module:factory`, which gives the function of
    `modelling.with_logits` and loads what it needs in each Python worker.
    """

    factory = Param(Params._dummy(), "factory", "package.module:factory of the model", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, factory=None, inputCols=("text", "poi"), outputCol="probs"):
        super().__init__()
        self._setDefault(inputCols=["text", "poi"], outputCol="probs")
        given = {k: list(v) if k == "inputCols" else v for k, v in self._input_kwargs.items()}
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        module, _, name = self.getOrDefault(self.factory).partition(":")
        words, context = self.getInputCols()
        clean = df.withColumn("_clean", text.strip(F.coalesce(words, F.lit(""))))
        scored = modelling.with_logits(clean, getattr(importlib.import_module(module), name),
                                       text="_clean", context=context, out="_logits")
        return modelling.with_probabilities(scored, "_logits", self.getOutputCol()).drop("_clean", "_logits")


class Stacked(Transformer, HasInputCols, HasOutputCol, _Saved):
    """Arrays side by side as one vector."""

    @keyword_only
    def __init__(self, *, inputCols=("presence", "probs"), outputCol="features"):
        super().__init__()
        self._setDefault(inputCols=["presence", "probs"], outputCol="features")
        given = {k: list(v) if k == "inputCols" else v for k, v in self._input_kwargs.items()}
        self._set(**given)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), vectors.to_vector(F.concat(*self.getInputCols())))


class ClassNames(Transformer, HasInputCol, _Saved):
    """The name that a predicted class had in training, as `label_name`."""

    names = Param(Params._dummy(), "names", "names of the classes by id", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol="prediction", names=None):
        super().__init__()
        self._setDefault(inputCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        number = self.getInputCol()
        named = df.withColumn(number, F.col(number).cast("int"))
        return metrics.with_label_name(named, number, dict(enumerate(self.getOrDefault(self.names))))


class _TfIdfParams(HasInputCol, HasOutputCol, _HasVocabulary):
    pass


class TfIdf(Estimator, _TfIdfParams, _Saved):
    """Learns in how many reviews each word of the vocabulary occurs.

    A word's weight is ln((1 + reviews) / (1 + reviews with it)) + 1.
    """

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="tfidf", vocabulary=None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="tfidf", vocabulary=list(fixed.VOCABULARY))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> TfIdfModel:
        words, column = self.getOrDefault(self.vocabulary), self.getInputCol()
        hits = F.explode(F.concat(F.array(F.lit(None).cast("string")), vectors.vocabulary_hits(F.col(column), words)))
        # The row without a word counts the review itself; at most one row a word and task travels.
        counts = {r["word"]: r["n"] for r in df.select(hits.alias("word")).groupBy("word").agg(
            F.count("*").alias("n")).collect()}
        weights = [math.log((1 + counts.get(None, 0)) / (1 + counts.get(w, 0))) + 1 for w in words]
        return self._copyValues(TfIdfModel(weights=weights))


class TfIdfModel(Model, _TfIdfParams, _Saved):
    """Sparse vectors of word counts times the weights of the words, of length one; without a word all zero."""

    weights = Param(Params._dummy(), "weights", "weights in the order of the vocabulary", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, weights=None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="tfidf", vocabulary=list(fixed.VOCABULARY))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        words = df.withColumn("_words", text.raw_tokens(F.col(self.getInputCol())))
        counted = CountVectorizerModel.from_vocabulary(
            self.getOrDefault(self.vocabulary), "_words", "_counts").transform(words)
        weighed = ElementwiseProduct(
            scalingVec=Vectors.dense(self.getOrDefault(self.weights)), inputCol="_counts",
            outputCol="_weighed").transform(counted)
        return Normalizer(p=2.0, inputCol="_weighed", outputCol=self.getOutputCol()).transform(
            weighed).drop("_words", "_counts", "_weighed")


def learned_vocabulary(df: DataFrame, size: int = len(fixed.VOCABULARY), column: str = "text") -> list[str]:
    """The `size` words said most often in all texts, ties in text order; in text order.

    Words are counted before the shuffle; each task keeps no more than `size` of them.
    """
    said = df.select(F.explode(text.raw_tokens(F.col(column))).alias("word")).where("word <> ''")
    most = said.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return sorted(r["word"] for r in most.collect())
