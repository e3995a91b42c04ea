"""Quality classifier by importance resampling.

Texts are bags of hashed n-grams: words, pairs of words, word beginnings, and runs of word shapes
(capitals, digits, marks, a word said again).  Two generative models give each
bucket the share of documents it occurs in, one for target documents and one for
all documents.  Their ratio is smoothed by one document and drawn towards 1 by as much as
it is in doubt.  The importance weight of a text is the sum of the logarithms of the ratios of its
buckets.  Documents are drawn without replacement in proportion
to their weights by Gumbel top-k: a Gumbel number is added to the logarithm of the
weight and the largest sums are taken.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm import common
from reviewmill.sources.ship import ship

#: Labelled rows that the target model and the cut are learned from, at most; drawn by hash.
SAMPLE_ROWS = 40_000
#: What losing all held-out target documents costs, where keeping all others costs 1.
LOSS = 25.0
#: Weights of the doubt about a ratio: its logarithm shrinks by so many of its variances over its size.
#: The one that tells held-out labels apart best is taken.
DOUBTS = (6.0, 9.0, 14.0, 20.0)
PREFIX = 6
_WORD_BITS, _SHAPE_BITS, _PAIR_BITS = 17, 14, 18
#: Where the buckets of words, word beginnings, shapes and pairs begin.
_STARTS, _SHAPES, _PAIRS = 1 << _WORD_BITS, 2 << _WORD_BITS, (2 << _WORD_BITS) + (1 << _SHAPE_BITS)
BUCKETS = _PAIRS + (1 << _PAIR_BITS)
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MOST_CACHED = 60_000
_FAR = 0xFFF
_AGAIN = np.uint64(5)


def _shape(token: str) -> int:
    if token.isupper() and len(token) > 1:
        return 1
    if token[0].isupper():
        return 2
    if token.islower():
        return 3
    if token[0].isdigit():
        return 4
    return zlib.crc32(token.encode("utf-8", "replace")) | 16


class Buckets:
    """Distinct buckets of a text; tokens seen before are looked up."""

    def __init__(self):
        self._numbers: dict[str, int] = {}
        self._rows = np.zeros((3, 1024), np.uint64)

    def _number(self, token: str) -> int:
        number = len(self._numbers)
        if number == self._rows.shape[1]:
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)], axis=1)
        word = token.lower()
        start = zlib.crc32(word[:PREFIX].encode("utf-8", "replace") + b"\x00")
        self._rows[:, number] = (
            zlib.crc32(word.encode("utf-8", "replace")), start, _shape(token))
        self._numbers[token] = number
        return number

    def of(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        if not tokens:
            return np.zeros(0, np.int64)
        if len(self._numbers) > _MOST_CACHED:
            self.__init__()
        known, add = self._numbers.get, self._number
        numbers = np.array([n if (n := known(t)) is not None else add(t) for t in tokens], np.int64)
        present = np.unique(numbers)
        words, starts = self._rows[0][present], self._rows[1][present]
        shift = np.uint64(64 - _WORD_BITS)
        found = [words * _MIX >> shift, (starts * _MIX >> shift) + np.uint64(_STARTS)]
        shapes = self._rows[2][numbers]
        every_word = self._rows[0][numbers]
        pairs = (every_word[:-1] * _MIX ^ every_word[1:] * _SECOND) * _MIX
        found.append((pairs >> np.uint64(64 - _PAIR_BITS)) + np.uint64(_PAIRS))
        shapes[1:][every_word[1:] == every_word[:-1]] = _AGAIN
        for size in (3, 5):
            if len(shapes) >= size:
                run = np.full(len(shapes) - size + 1, size, np.uint64)
                for i in range(size):
                    run = run * _MIX + shapes[i:len(shapes) - size + 1 + i]
                run ^= run >> np.uint64(29)
                found.append((run * _MIX >> np.uint64(64 - _SHAPE_BITS)) + np.uint64(_SHAPES))
        return np.unique(np.concatenate(found)).astype(np.int64)


def packed(buckets: np.ndarray) -> bytes:
    """Buckets in order as their gaps in 12 bits; a gap of _FAR or more has a mark for each _FAR before its rest."""
    gaps = np.diff(buckets, prepend=0)
    marks, rest = gaps // _FAR, gaps % _FAR
    size = len(gaps) + int(marks.sum())
    codes = np.full(size + size % 2, _FAR, np.uint16)
    codes[np.arange(len(gaps)) + np.cumsum(marks)] = rest
    first, second = codes[::2], codes[1::2]
    return np.stack([first & 255, first >> 8 | (second & 15) << 4, second >> 4], axis=1).astype(np.uint8).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64).T
    gaps = np.stack([low | (middle & 15) << 8, middle >> 4 | high << 4], axis=1).ravel()
    return np.cumsum(gaps)[gaps != _FAR]


def bucketed(docs: DataFrame, keep: list[str], text_col: str, out: str) -> DataFrame:
    """The columns `keep` of all rows and in `out` the `packed` buckets of their texts.

    Every text is read whole, once; the rows are written to the shared folder.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def buckets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Buckets()
        for texts in batches:
            yield pa.array([packed(own.of(t)) for t in texts.to_pylist()], pa.binary())

    with common.small_batches(docs.sparkSession, 500):
        return common.staged(docs.select(*keep, buckets(F.col(text_col)).alias(out)), "bucketed-documents")


def _counts(rows: DataFrame, chosen: DataFrame, id_col: str, buckets: str) -> np.ndarray:
    """Documents, and target documents, with each bucket, and in the last place all of them.

    Each task gives one row for each bucket it has met, so
    that what is shuffled and what the driver gets is bounded by the buckets.
    """
    marked = rows.select(F.col(id_col).alias("id"), F.col(buckets).alias("buckets")).join(
        F.broadcast(chosen.select(F.col(id_col).alias("target"))), F.col("id") == F.col("target"), "left")
    schema = common.struct(("bucket", "int"), ("all_docs", "bigint"), ("target_docs", "bigint"))

    def count(batches):
        seen = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            targets = batch.column(1).is_valid().to_pylist()
            for raw, target in zip(batch.column(0).to_pylist(), targets):
                met = unpacked(raw)
                seen[0, met] += 1
                seen[0, BUCKETS] += 1
                if target:
                    seen[1, met] += 1
                    seen[1, BUCKETS] += 1
        met = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(seen[0, met]), pa.array(seen[1, met])],
            schema.names)

    counted = marked.select("buckets", "target").mapInArrow(count, schema)
    found = counted.groupBy("bucket").agg(
        F.sum("all_docs").alias("all_docs"), F.sum("target_docs").alias("target_docs")).toPandas()
    out = np.zeros((2, BUCKETS + 1))
    out[0, found["bucket"]], out[1, found["bucket"]] = found["all_docs"], found["target_docs"]
    return out


def ratios(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the logarithm of target share over raw share, and how sure it is.

    With e target documents expected to have the bucket and t that have it, the ratio is
    (t + 1) / (e + 1), and its logarithm has a variance of about 1 / (e + 1); the second number is its
    square over that variance.  Without target documents all ratios are 1.
    """
    total, target = counts[:, BUCKETS]
    if not total or not target:
        return np.zeros(BUCKETS), np.zeros(BUCKETS)
    expected = counts[0, :BUCKETS] * (target / total) + 1
    ratio = np.log((counts[1, :BUCKETS] + 1) / expected)
    return ratio, ratio * ratio * expected


def shrunk(ratio: np.ndarray, sure: np.ndarray, doubt: float) -> np.ndarray:
    """The logarithms drawn towards 0 by their doubt; those in which there is more doubt than proof are 0."""
    return ratio * np.maximum(0.0, 1 - doubt / np.maximum(sure, 1e-12))


def gumbel(id_col: str, seed: int) -> Column:
    """A standard Gumbel number for each id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11)
    return -F.log(-F.log((bits.cast("double") + 0.5) * F.lit(2.0 ** -53)))


def labelled_sample(labels: DataFrame, sample_rows: int, id_col: str) -> DataFrame:
    """(id, target, fit) of the labelled rows with the smallest hashes.

    Target documents are of good quality and not toxic in all of their labels; two thirds
    of them are to fit the model.  The others, and all that are no target, place the cut.
    """
    one = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(F.col("quality")).alias("_quality"), F.max(F.col("toxic")).alias("_toxic"))
    draw = F.xxhash64(id_col)
    drawn = one.withColumn("_draw", draw).orderBy("_draw", id_col).limit(sample_rows)
    target = F.expr("_quality = 1 AND _toxic = 0")
    fit = F.pmod(F.shiftrightunsigned("_draw", 7), F.lit(3)) < 2
    return drawn.where("_quality IS NOT NULL AND _toxic IS NOT NULL").select(
        id_col, target.alias("target"), (target & fit).alias("fit"))


def _weighed(rows: DataFrame, table: np.ndarray, buckets: str, seed: int, id_col: str,
             weight_col: str, key_col: str) -> DataFrame:
    """The rows with the logarithm of the weight, and that and a Gumbel number, in place of the buckets."""
    shared = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    @F.arrow_udf("double")
    def weight(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value
        for raws in batches:
            yield pa.array([float(table[unpacked(r)].sum(dtype=np.float64)) for r in raws.to_pylist()],
                           pa.float64())

    weighed = rows.withColumn(weight_col, weight(F.col(buckets))).drop(buckets)
    return weighed.withColumn(key_col, F.col(weight_col) + gumbel(id_col, seed))


def best_cut(target: np.ndarray, others: np.ndarray, loss: float = LOSS) -> tuple[float, float]:
    """The least key to keep, by the keys of held-out target documents and of others, and its cost.

    The cost is `loss` times the share of targets below it and the share
    of others from it on; of cuts of equal cost it is the lowest.  Without targets or others all are kept.
    """
    if not len(target) or not len(others):
        return float("-inf"), 1.0
    target, others = np.sort(target), np.sort(others)
    cuts = np.concatenate([[-np.inf], target])
    lost = np.searchsorted(target, cuts) / len(target)
    kept = 1 - np.searchsorted(others, cuts) / len(others)
    costs = loss * lost + kept
    return float(cuts[np.argmin(costs)]), float(costs.min())


def _chosen(rows: DataFrame, sample: DataFrame, ratio: np.ndarray, sure: np.ndarray, buckets: str,
            seed: int, id_col: str, loss: float) -> tuple[np.ndarray, float]:
    """The shrunk ratios that tell held-out documents apart best, and the cut; of equals the most shrunk.

    The sample bounds what the driver sees.
    """
    held = rows.select(F.col(id_col).alias("id"), F.col(buckets).alias("buckets")).join(
        F.broadcast(sample.where("NOT fit").withColumnRenamed(id_col, "id")), "id")
    doubts = sorted(DOUBTS, reverse=True)
    shared = rows.sparkSession.sparkContext.broadcast((ratio, sure))

    @F.arrow_udf("array<double>")
    def weights(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = [shrunk(*shared.value, d).astype(np.float32) for d in doubts]
        for raws in batches:
            met = [unpacked(r) for r in raws.to_pylist()]
            yield pa.array([[float(t[m].sum(dtype=np.float64)) for t in tables] for m in met],
                           pa.list_(pa.float64()))

    found = held.select("target", gumbel("id", seed).alias("gumbel"), weights("buckets").alias("weights")).toPandas()
    shared.destroy()
    target, best = found["target"].to_numpy(bool), None
    each = np.array(found["weights"].tolist()).reshape(len(found), len(doubts))
    for doubt, weight in zip(doubts, each.T):
        key = weight + found["gumbel"].to_numpy()
        least, cost = best_cut(key[target], key[~target], loss)
        if best is None or cost < best[0]:
            best = cost, shrunk(ratio, sure, doubt), least
    return best[1:]


def kth_largest(keys: DataFrame, k: int, bins: int = 1000, most: int = 10_000) -> float:
    """The k-th largest `_key`, found by counting ever smaller ranges; at most `most` keys are brought in."""
    low, high, total = keys.agg(F.min("_key"), F.max("_key"), F.count("_key")).first()
    if k <= 0 or total == 0:
        return float("inf")
    if k >= total:
        return low
    key, above = F.col("_key"), 0  # above: how many keys are over `high`
    while True:
        within = keys.where((key >= low) & (key <= high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        number = F.least(F.floor((key - low) / width), F.lit(bins - 1)).alias("bin")
        ranges = within.groupBy(number).agg(
            F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        for r in sorted(ranges.collect(), key=lambda r: -r.bin):
            if above + r.n >= k:
                break
            above += r.n
        low, high = r.low, r.high
        if r.n <= most or low == high:
            rows = keys.where((key >= low) & (key <= high)).orderBy(key.desc()).limit(
                min(most, k - above)).select("_key").collect()
            return rows[-1][0] if low != high else low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None,
             loss: float = LOSS, sample_rows: int = SAMPLE_ROWS, seed: int = 7,
             id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
             names: tuple[str, str, str] = ("_weight", "_key", "_kept")) -> DataFrame:
    """All rows of `docs`, with the columns `keep` or all, and weight, key and whether drawn, called `names`.

    The k rows with the largest keys are drawn.  Without `k` it is as many as have the key that
    parts target documents the model has not seen best from other labelled ones (`best_cut`).
    Rows whose key equals the smallest one drawn are drawn too, so repeated rows share
    their fate.  Rows without a text have weight 0, rows without an id share one
    Gumbel number.  Without labels all weights are 0 and all rows are drawn.
    Kept columns must not be called like the results.
    """
    keep = list(dict.fromkeys([id_col, *keep])) if keep is not None else docs.columns
    if clash := set(names) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are names of the result")
    weight_col, key_col, kept_col = names
    buckets = common.free(docs, "_buckets")
    sample = common.staged(labelled_sample(labels, sample_rows, id_col), "labelled-sample")
    rows = bucketed(docs, keep, text_col, buckets)
    ratio, sure = ratios(_counts(rows, sample.where("fit"), id_col, buckets))
    table, least = _chosen(rows, sample, ratio, sure, buckets, seed, id_col, loss)
    narrow = rows.select(F.col(id_col).alias("id"), F.col(buckets).alias("buckets"))
    keys = common.staged(_weighed(narrow, table, "buckets", seed, "id", "_weight", "_key"), "document-keys")
    if k is None:
        k = keys.where(F.col("_key") >= F.lit(least)).count()
    drawn = _weighed(rows, table, buckets, seed, id_col, weight_col, key_col)
    return drawn.withColumn(kept_col, F.col(key_col) >= F.lit(kth_largest(keys, k)))
