"""Keys that shuffle in a few bytes, whatever the length of the text behind them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reviewmill.functions.vectors import literal_array


def fingerprint(col: Column) -> Column:
    """256-bit digest as 32 bytes of binary, never null.

    A key that cannot be null spares the joins on it a null filter, which would
    compute the digest twice and keep the two uses from sharing one shuffle.
    """
    return F.coalesce(F.unhex(F.sha2(col, 256)), F.lit(b""))


def null_safe_fingerprint(*cols: Column) -> Column:
    """Digest of several columns in which nulls equal each other and nothing else."""
    parts = [F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in cols]
    return fingerprint(F.concat(*parts))


def hash_number(col: Column) -> Column:
    """First 32 bits of the MD5 digest as a bigint, the same on every engine."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")


def seeded(key: Column, salt: object) -> Column:
    """`key-salt` as text: the input of every seeded choice."""
    return F.concat(key.cast("string"), F.lit(f"-{salt}"))


def pick(options: tuple[str, ...], key: Column, salt: object) -> Column:
    """Reproducible uniform choice from a short literal list."""
    slot = F.pmod(hash_number(seeded(key, salt)), F.lit(len(options)))
    return F.element_at(literal_array(options), (slot + 1).cast("int"))
