"""Text expressions with Unicode semantics, all evaluated inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from reviewmill import fixed

# Java's Unicode \s plus U+001C..U+001F: the characters that separate words.
WS = r"[\s\x1c-\x1f]"
WS_RUN = rf"(?U){WS}+"
# Whitespace runs other than one plain space, which needs no replacement.
WS_IRREGULAR = rf"(?U)(?:[\s\x1c-\x1f&&[^ ]]| (?={WS})){WS}*"
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


# The characters of the punctuation class; all lie below U+3000.  Removing them
# one by one from a table is faster than matching the class.
PUNCTUATION_CHARS = "".join(re.findall(fixed.PUNCTUATION, "".join(map(chr, range(0x3000)))))
# Whitespace that is not removed as punctuation first.
_KEPT_WS = "".join(c for c in WS_CHARS if c not in PUNCTUATION_CHARS)


def strip(col: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.trim(col, F.lit(WS_CHARS))


def words(col: Column) -> Column:
    """Whitespace-separated words as an array (no lambda: stays in codegen)."""
    return F.array_remove(F.split(col, WS_RUN), "")


def word_count(col: Column) -> Column:
    return F.array_size(words(col)).cast("bigint")


def char_count(col: Column) -> Column:
    """Length in code points."""
    return F.length(col).cast("bigint")


def matches(col: Column, pattern: str, leading: str = "") -> Column:
    """Case-insensitive search with Unicode classes.

    `leading` names the characters every match starts with, where they are
    known: a look-ahead then skips most positions without trying alternatives.
    """
    guard = f"(?=[{leading}])" if leading else ""
    return col.rlike(f"(?iuU){guard}{pattern}")


def uppercase_count(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"(?U)[^\p{IsUppercase}]+", ""))


def occurrences(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def remove_punctuation(col: Column) -> Column:
    return F.translate(F.coalesce(col, F.lit("")), PUNCTUATION_CHARS, "")


def normalize_whitespace(col: Column) -> Column:
    """Whitespace runs (control characters included) become one space; trimmed."""
    return strip(F.regexp_replace(F.coalesce(col, F.lit("")), WS_IRREGULAR, " "))


def normalize(col: Column) -> Column:
    """Drop punctuation, lower-case, then normalise whitespace, in that order."""
    return normalize_whitespace(F.lower(remove_punctuation(col)))


def raw_tokens(col: Column) -> Column:
    """Words of the normalised text, repeats and empty strings among them.

    One pass drops the punctuation and turns every whitespace into a space.
    """
    spaced = F.translate(
        F.coalesce(col, F.lit("")), _KEPT_WS + PUNCTUATION_CHARS, " " * len(_KEPT_WS))
    return F.split(F.lower(spaced), " ")


def tokens(col: Column) -> Column:
    """Distinct words of the normalised text, in order of first appearance."""
    return F.array_distinct(F.array_remove(raw_tokens(col), ""))


def preview(col: Column, chars: int, always: bool = False) -> Column:
    """First `chars` characters and dots; the dots only when cut, unless `always`."""
    cut = F.concat(F.substring(col, 1, chars), F.lit("..."))
    return cut if always else F.when(F.length(col) > chars, cut).otherwise(col)


def poi(company: Column, category: Column, stars: Column) -> Column:
    """Point-of-interest context string of a review."""
    return F.concat(
        F.lit("POI: "), strip(F.coalesce(company, F.lit(""))),
        F.lit(" [CAT_"), F.coalesce(category, F.lit("None")),
        F.lit("] [RATING_"), F.coalesce(stars.cast("string"), F.lit("None")), F.lit("]"),
    )
