"""Rule set A: four boolean flags per review."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill import fixed
from reviewmill.functions import keys, text
from reviewmill.operators import duplicates


@dataclass(frozen=True)
class FlagRules:
    min_words: int = fixed.FLAG_MIN_WORDS
    min_chars: int = fixed.FLAG_MIN_CHARS
    patterns: tuple[str, ...] = fixed.FLAG_PATTERNS


# Characters a match of the known pattern sets starts with.  Such a set is
# searched as one expression, in one pass over the text.
_LEADING = {fixed.FLAG_PATTERNS: r"hw\d", fixed.FLAG_PATTERNS_CORRECTED: r"hw\d"}


def pattern_flag(col: Column, patterns: tuple[str, ...] = fixed.FLAG_PATTERNS) -> Column:
    """Any pattern found; a missing text is spam."""
    if patterns in _LEADING:
        found = text.matches(col, f"(?:{'|'.join(patterns)})", _LEADING[patterns])
    else:
        found = reduce(or_, (text.matches(col, p) for p in patterns))
    return F.coalesce(found, F.lit(True))


def length_flag(
    col: Column, min_words: int = fixed.FLAG_MIN_WORDS, min_chars: int = fixed.FLAG_MIN_CHARS
) -> Column:
    """Too few words or characters of the text as it stands; a missing text is spam."""
    return F.coalesce(
        (F.length(col) < min_chars) | (text.word_count(col) < min_words), F.lit(True)
    )


def duplicate_key() -> Column:
    return keys.null_safe_fingerprint(F.col("business_name"), F.col("text"))


def mark_duplicates(df: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """`spam_duplicate`: every member of an equal (business_name, text) group."""
    if groups is None:
        groups = duplicates.duplicate_groups(df, duplicate_key())
    return (
        duplicates.attach_groups(df.withColumn("_key", duplicate_key()), groups, "_key")
        .withColumn("spam_duplicate", F.col("_copies").isNotNull())
        .drop("_first_id", "_copies")
    )


def mark_spam(
    df: DataFrame, rules: FlagRules = FlagRules(), groups: DataFrame | None = None
) -> DataFrame:
    """Add spam_regex, spam_length, spam_duplicate and is_spam.

    The text flags are computed before the duplicate join, so the text itself
    only travels when the caller keeps it.
    """
    if groups is None:
        groups = duplicates.duplicate_groups(df, duplicate_key())
    flagged = df.withColumns({
        "spam_regex": pattern_flag(F.col("text"), rules.patterns),
        "spam_length": length_flag(F.col("text"), rules.min_words, rules.min_chars),
    })
    return mark_duplicates(flagged, groups).withColumn(
        "is_spam", F.col("spam_regex") | F.col("spam_length") | F.col("spam_duplicate")
    )
