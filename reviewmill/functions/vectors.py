"""Array and vector expressions: presence, softmax, argmax, parsing."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, functions as F

from reviewmill import fixed
from reviewmill.functions import text


def literal_array(values) -> Column:
    """A constant array of words, folded by the optimiser; one literal to send."""
    return F.split(F.lit("\n".join(values)), "\n")


def vocabulary_hits(col: Column, vocabulary=fixed.VOCABULARY) -> Column:
    """Vocabulary words found in the text, in vocabulary order (one hash pass)."""
    return F.array_intersect(literal_array(vocabulary), text.raw_tokens(col))


def presence(hits: Column, vocabulary=fixed.VOCABULARY) -> Column:
    """Binary vector over the vocabulary from the words of `vocabulary_hits`.

    The hits are bound to a variable, so they are computed once for each row, also where the
    optimiser puts their expression here; in the inner lambda it would run again for every word.
    """
    def found(own: Column) -> Column:
        ones = F.transform(literal_array(vocabulary), lambda w: F.array_contains(own, w).cast("double"))
        return F.when(F.array_size(own) == 0, F.array_repeat(F.lit(0.0), len(vocabulary))).otherwise(ones)

    return F.get(F.transform(F.array(hits), found), F.lit(0))


def softmax(logits: Column) -> Column:
    """Softmax of an array of logits, shifted by the maximum."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda w: w / total)


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def parse_vector(json_text: Column) -> Column:
    """JSON text of a number list as `array<double>`; null when it is not one."""
    return F.from_json(json_text, "array<double>")


def to_vector(values: Column) -> Column:
    return array_to_vector(values)
