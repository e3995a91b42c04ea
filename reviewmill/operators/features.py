"""Text and context features for the two model stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill import fixed
from reviewmill.functions import text, vectors


def vocabulary(spark: SparkSession, words=fixed.VOCABULARY) -> DataFrame:
    """The vocabulary as a table (word_index, word)."""
    return spark.createDataFrame(list(enumerate(words)), "word_index int, word string")


def with_presence(df: DataFrame, column: str = "text", out: str = "presence") -> DataFrame:
    """Add the binary vocabulary vector; a missing text gives zeros."""
    hits = vectors.vocabulary_hits(F.col(column))
    return (
        df.withColumn("_hits", hits)
        .withColumn(out, vectors.presence(F.col("_hits")))
        .drop("_hits")
    )


def document_frequency(df: DataFrame, column: str = "text") -> DataFrame:
    """Reviews holding each vocabulary word, words without any kept at zero.

    Each review sends only the vocabulary words it holds, counted before the
    shuffle; at most one row per word and map task travels.
    """
    counts = (
        df.select(F.explode(vectors.vocabulary_hits(F.col(column))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    return vocabulary(df.sparkSession).join(counts, "word", "left").select(
        "word_index", "word", F.coalesce("n", F.lit(0)).alias("n_reviews")
    )


def with_poi(df: DataFrame, company: str = "company_name") -> DataFrame:
    return df.withColumn("poi", text.poi(F.col(company), F.col("category"), F.col("stars")))


def model_pairs(df: DataFrame) -> DataFrame:
    """Trimmed text and context string, the two inputs of the first model."""
    clean = text.strip(F.coalesce("text", F.lit("")))
    kept = [c for c in ("review_id", "label") if c in df.columns]
    return with_poi(df).select(*kept, clean.alias("text"), "poi")


def special_tokens(df: DataFrame) -> DataFrame:
    """Category tokens in sorted order, then the rating tokens: (kind, value, token)."""
    categories = df.select(
        F.lit(0).alias("kind"), F.coalesce("category", F.lit("None")).alias("value")
    ).distinct()
    ratings = df.sparkSession.createDataFrame(
        [(1, str(r)) for r in fixed.RATINGS], "kind int, value string"
    )
    prefix = F.when(F.col("kind") == 0, F.lit("[CAT_")).otherwise(F.lit("[RATING_"))
    return (
        categories.union(ratings)
        .withColumn("token", F.concat(prefix, "value", F.lit("]")))
        .orderBy("kind", "value")
    )


def with_parsed_vector(df: DataFrame, column: str, out: str = "vector") -> DataFrame:
    """Read a vector kept as JSON text."""
    return df.withColumn(out, vectors.parse_vector(F.col(column)))
