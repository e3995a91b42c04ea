"""Importance resampling towards a target distribution over hashed word n-grams.

Buckets are CRC-32 checksums of whole features, many at once: CRC-32 is
linear, so that a checksum is the exclusive or of what each byte contributes at its
distance from the end of the feature, and of a constant for the length.  The
contributions come from a table of distance and byte and are folded for all features by one
`bitwise_xor.reduceat`.  A feature longer than the table is cut into blocks
counted from its end; each block's sum is moved on by the blocks behind it, a power of two at a time.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm import common
from reviewmill.operators import numbering
from reviewmill.sources.ship import ship

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 2024, 10, 20
#: Distances from the end that the table holds, and bytes of a block.
SPAN = 64
#: Bytes of texts, features, and blocks of features that are worked on at once.
_BYTES, _FEATURES, _BLOCKS = 1 << 20, 1 << 17, 1 << 15
_ONES = np.uint32(0xFFFFFFFF)
_POLYNOMIAL = 0xEDB88320
#: Bytes of words: digits, small letters and all that is not ASCII.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@functools.cache
def _bytes_table() -> np.ndarray:
    """What one byte does to a register of zeros."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


def _advance(states: np.ndarray) -> np.ndarray:
    """Registers after one more zero byte."""
    return states >> np.uint32(8) ^ _bytes_table()[states & np.uint32(255)]


@functools.cache
def _positions() -> tuple[np.ndarray, np.ndarray]:
    """(distance from the end, byte) -> contribution; length -> constant, for lengths up to SPAN."""
    rows, constants = [_bytes_table()], [np.array([_ONES])]
    for _ in range(SPAN - 1):
        rows.append(_advance(rows[-1]))
    for _ in range(SPAN):
        constants.append(_advance(constants[-1]))
    return np.concatenate(rows), np.concatenate(constants)


@functools.cache
def _moves(power: int) -> np.ndarray:
    """(byte of the register, its value) -> the register SPAN * 2 ** power zero bytes later."""
    if power:
        half = _moves(power - 1)
        return _moved(half, half)
    states = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(SPAN):
        states = _advance(states)
    return states


def _moved(states: np.ndarray, moves: np.ndarray) -> np.ndarray:
    parts = [moves[(states >> np.uint32(8 * k) & np.uint32(255)) + 256 * k] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


def _by_blocks(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Registers moved on by so many blocks of zero bytes each."""
    most = int(blocks.max(initial=0))
    for power in range(most.bit_length()):
        own = np.flatnonzero(blocks >> power & 1)
        states[own] = _moved(states[own], _moves(power))
    return states


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def _folded(table: np.ndarray, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What the bytes of each block contribute."""
    lengths = ends - starts
    places = _ranges(starts, lengths)
    distance = np.repeat(ends - 1, lengths) - places
    return np.bitwise_xor.reduceat(table[distance * 256 + buffer[places]], np.cumsum(lengths) - lengths)


def crc32(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of the bytes; none may be empty."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    table, constants = _positions()
    sizes = ends - starts
    behind = (sizes - 1) // SPAN  # blocks behind the first one of each span
    if not behind.any():
        firsts, block_ends, left = starts, ends, None
    else:
        left = np.repeat(behind, behind + 1) - _ranges(np.zeros_like(behind), behind + 1)
        block_ends = np.repeat(ends, behind + 1) - left * SPAN
        firsts = np.maximum(block_ends - SPAN, np.repeat(starts, behind + 1))
    found = np.concatenate([
        _folded(table, buffer, firsts[at:at + _BLOCKS], block_ends[at:at + _BLOCKS])
        for at in range(0, len(firsts), _BLOCKS)])
    tail = constants[sizes - behind * SPAN]
    if left is not None:
        found = _by_blocks(found, left)
        found = np.bitwise_xor.reduceat(found, np.cumsum(behind + 1) - behind - 1)
        tail = _by_blocks(tail, behind)
    return found ^ tail ^ _ONES


def features(texts: list[bytes], longest: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and in parts the text and the checksum of each feature."""
    buffer = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = _IN_WORD[buffer]
    if longest > 1:  # one space between words
        kept = inside | np.concatenate([[False], inside[:-1]])
        limits = np.concatenate([[0], np.cumsum(kept)])
        buffer, inside = np.where(inside, buffer, np.uint8(32))[kept], inside[kept]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends if longest == 1 else limits[text_ends], starts, "right")

    def parts():
        for size in range(1, min(longest, len(starts)) + 1):
            first, last = starts[:len(starts) - size + 1], ends[size - 1:]
            same = owner[:len(first)] == owner[size - 1:]
            first, last, own = first[same], last[same], owner[:len(same)][same]
            for at in range(0, len(first), _FEATURES):
                part = slice(at, at + _FEATURES)
                yield own[part], crc32(buffer, first[part], last[part])

    return np.bincount(owner, minlength=len(texts)), parts()


def hashed(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[slice, np.ndarray, Iterator]]:
    """For runs of texts: which they are, the words of each, and (text in the run, bucket) of all features."""
    every = common.binary(texts)
    at = 0
    while at < len(every):
        to, size = at, 0
        while to < len(every) and (to == at or size + len(every[to]) <= _BYTES):
            size += len(every[to])
            to += 1
        words, parts = features(every[at:to], longest)
        yield slice(at, to), words, ((own, (crc % np.uint32(buckets)).astype(np.int64)) for own, crc in parts)
        at = to


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts of the table's one column in each bucket.

    Each task gives one row for each bucket it has met, so that what is shuffled and what
    the driver gets is bounded by the buckets.
    """
    schema = common.struct(("bucket", "int"), ("n", "bigint"))
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, parts in hashed(batch.column(0), longest, buckets):
                for _, found in parts:
                    seen += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(seen[met])], schema.names)

    rows = texts.mapInArrow(count, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over raw share of each bucket, one added to each, rounded down."""
    buckets, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
        for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(row_id: Column, seed: int) -> Column:
    """A Gumbel number in thousandths, rounded down, from a digest of seed and id; a missing id counts as no text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id",
             text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of `docs`.

    Features are all runs of 1 to `longest` words.  The weight of a row is the mean gain of
    its features, rounded down, 0 without any.  Of the rows with `min_words` words
    `percent` in a hundred are drawn, those with the highest scores, ties by smaller id and then in the
    order of the files; they are ranked from 1, all others have no rank.  A missing text has no
    words; a missing id is the smallest one.  Repeated rows are drawn one by one.  Empty tables give
    an empty result, an empty target one where rarer words weigh more.  Other columns do not matter.
    The rows are ranked by ranges of the score; no task and not the driver sees all of them.
    """
    raw = bucket_counts(docs.select(text_col), longest, buckets)
    table = gains(raw, bucket_counts(target.select(target_col), longest, buckets))
    schema = common.struct((id_col, common.id_type(docs, id_col)), ("n_words", "bigint"),
                           ("n_features", "bigint"), ("weight", "bigint"))

    def weigh(batch: pa.RecordBatch) -> dict:
        n_words, n_features, weights = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for run, words, parts in hashed(batch.column(1), longest, buckets):
            n_words[run] = words
            for own, found in parts:
                np.add.at(n_features[run], own, 1)
                np.add.at(weights[run], own, table[found])
        weights = np.where(n_features, weights // np.maximum(n_features, 1), 0)
        return {id_col: batch.column(0), "n_words": pa.array(n_words), "n_features": pa.array(n_features),
                "weight": pa.array(weights)}

    weighed = common.map_rows(docs.select(id_col, text_col), schema, weigh)
    scored = common.staged(
        weighed.withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
        .withColumn("_place", F.monotonically_increasing_id()), "scored-documents")
    fits = F.col("n_words") >= min_words
    drawn = scored.where(fits).count() * percent // 100
    ranked = numbering.numbered(scored, fits.desc(), F.col("score").desc(), F.col(id_col), F.col("_place"),
                                out="_before")
    rank = F.when(F.col("_before") < drawn, F.col("_before") + 1).cast("bigint")
    return ranked.select(id_col, "n_words", "n_features", "weight", "score", rank.alias("rank"))
