"""Language identification by the nearest of several centroids for each language.

A text becomes the TF-IDF vector of its hashed character n-grams, of length one.
The vectors of each language are clustered by cosine, so that short and long texts,
or texts of capitals, can have centroids of their own.  A text takes the language of the
centroid with the largest cosine; one that is farther from it than nearly all
texts the centroid was learned from is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm import common
from reviewmill.sources.ship import ship

#: Texts of a language that centroids are learned from, about; drawn by hash.
PER_LANGUAGE = 2_000
#: Languages that a model can have; the centroids, all broadcast, are 512 KB for each.
MOST_LANGUAGES = 250
CLUSTERS, ROUNDS, LONGEST = 4, 10, 4
#: A text is rejected below this part of the cosine that all but this share of a cluster's texts reach.
LEAST_PART, BEYOND = 0.8, 0.002
BITS = 15
BUCKETS = 1 << BITS
NO_LANGUAGE = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Code points hashed at once; bounds the memory a long text takes.
_BLOCK = 1 << 18


def _separators() -> np.ndarray:
    """Of the code points up to U+303F, those that never are part of a word."""
    out = np.zeros(0x3040, bool)
    out[:0xC0] = [not chr(c).isalpha() for c in range(0xC0)]
    for first, last in ((0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x3000, 0x3004), (0x3007, 0x3030)):
        out[first:last + 1] = True
    return out


_SEPARATORS = _separators()


def counts(text: str) -> np.ndarray:
    """How many character n-grams of the text fall into each bucket; words stand between single spaces."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    low = points < len(_SEPARATORS)
    between = np.zeros(len(points), bool)
    between[low] = _SEPARATORS[points[low]]
    points = np.where(between, np.uint32(32), points)
    points = points[~(between & np.concatenate([[False], between[:-1]]))]
    found = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(points), _BLOCK):
        part = points[at:at + _BLOCK + LONGEST - 1].astype(np.uint64)
        starts = min(_BLOCK, len(points) - at)
        grams = np.zeros(len(part), np.uint64)
        for size in range(1, LONGEST + 1):
            ends = part[size - 1:]
            grams = (grams[:len(ends)] + ends + np.uint64(size)) * _MIX
            own = grams[:starts]
            if size == 1:
                own = own[ends[:starts] != 32]
            mixed = (own ^ (own >> np.uint64(29))) * _MIX
            found += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=BUCKETS)
    return found


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text and its weights in them, of length one."""
    found = counts(text)
    buckets = np.flatnonzero(found)
    weights = (1 + np.log(found[buckets])) * idf[buckets]
    return buckets, weights / (np.sqrt((weights * weights).sum()) or 1.0)


def _inverse_frequency(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency of each bucket over all texts of the table's one column.

    Each task gives one row for each bucket it has met.
    """
    schema = common.struct(("bucket", "int"), ("n", "bigint"))
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[:BUCKETS] += counts(text) > 0
                seen[BUCKETS] += 1
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(seen[met])], schema.names)

    rows = texts.mapInArrow(count, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(BUCKETS + 1)
    seen[rows["bucket"]] = rows["n"]
    return np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1


def cluster(vectors: list[tuple[np.ndarray, np.ndarray]], most: int = CLUSTERS, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Centroids of the vectors by cosine, and for each the least cosine that is not rejected.

    The first vectors are the first centroids.
    """
    places = np.concatenate([b for b, _ in vectors])
    weights = np.concatenate([w for _, w in vectors])
    starts = np.concatenate([[0], np.cumsum([len(b) for b, _ in vectors])[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(vectors)), [len(b) for b, _ in vectors])
    centroids = np.zeros((min(most, len(vectors)), BUCKETS))
    for row, (buckets, own) in zip(centroids, vectors):
        row[buckets] = own
    nearest = None
    for _ in range(rounds):
        cosines = np.stack([np.add.reduceat(weights * c[places], starts) for c in centroids])
        if nearest is not None and (cosines.argmax(axis=0) == nearest).all():
            break
        nearest = cosines.argmax(axis=0)
        for k in range(len(centroids)):
            if (mine := nearest[owner] == k).any():
                total = np.bincount(places[mine], weights[mine], minlength=BUCKETS)
                centroids[k] = total / np.sqrt((total * total).sum())
    cosines = np.stack([np.add.reduceat(weights * c[places], starts) for c in centroids])
    nearest = cosines.argmax(axis=0)
    return [(centroids[k], LEAST_PART * float(np.quantile(cosines[k][nearest == k], BEYOND)))
            for k in range(len(centroids)) if (nearest == k).any()]


@dataclass(frozen=True)
class Model:
    """Languages in text order, one for each centroid; buckets x centroids; least cosines; the weights of buckets."""

    languages: tuple[str, ...]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def nearest(self, text: str) -> tuple[int, float]:
        """The centroid with the largest cosine, the first of equals, and that cosine."""
        buckets, weights = vector(text, self.idf)
        cosines = weights @ self.centroids[buckets]
        best = int(cosines.argmax())
        return best, min(max(float(cosines[best]), 0.0), 1.0)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
          per_language: int = PER_LANGUAGE) -> Model:
    """The model of the texts with a language and a letter; without any it has no centroids.

    Document frequencies count all of them.  The centroids of a language are learned
    from about `per_language` texts, those whose hash of id and text is small enough for the number
    there are.  Repeated rows count as they come.  More than MOST_LANGUAGES languages raise an error.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                        F.col(text_col).alias("text"))
    known = known.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = known.groupBy("lang").agg(F.count("*").alias("size")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.ones(BUCKETS))
    idf = _inverse_frequency(known.select("text"))
    limits = spark.createDataFrame([(r["lang"], min(1.0, per_language / r["size"])) for r in sizes],
                                   "lang string, share double")
    draw = F.xxhash64("id", "text")
    point = F.shiftrightunsigned("draw", 11).cast("double") * F.lit(2.0 ** -53)
    drawn = known.withColumn("draw", draw).join(F.broadcast(limits), "lang").where(point < F.col("share"))

    def vectors(batch: pa.RecordBatch) -> dict:
        pairs = [vector(t, idf) for t in batch.column(2).to_pylist()]
        return {"lang": batch.column(0), "draw": batch.column(1),
                "buckets": [b.astype(np.uint16).tobytes() for b, _ in pairs],
                "weights": [w.astype(np.float32).tobytes() for _, w in pairs]}

    schema = common.struct(("lang", "string"), ("draw", "bigint"), ("buckets", "binary"), ("weights", "binary"))
    made = common.map_rows(drawn.select("lang", "draw", "text"), schema, vectors)

    def centroids(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group[c].to_pylist() for c in ("draw", "buckets", "weights"))))
        pairs = [(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(w, np.float32).astype(float))
                 for _, b, w in rows]
        found = cluster(pairs)
        return pa.table({"lang": [group["lang"][0].as_py()] * len(found),
                         "centroid": [c.astype(np.float32).tobytes() for c, _ in found],
                         "least": [x for _, x in found]})

    rows = made.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary, least double").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    return Model(tuple(r["lang"] for r in rows),
                 np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows], axis=1),
                 np.array([r["least"] for r in rows]), idf)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",),
            text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, with `lang_pred`, `score` and `rejected`.

    A text without a letter, a missing one, and every text where the model has no
    centroid, is `und` with score 0.  Any other takes the language of the nearest centroid, ties
    the first language; its score is the cosine.  `rejected` says that it lies farther away than the texts
    that the centroid stands for; callers decide what becomes of those.  Whole texts are read.
    Repeated rows get equal results, an empty table gives an empty one.  Columns of `keep` called like
    the three results raise an error; other columns of `docs` do not matter.
    """
    if clash := {"lang_pred", "score", "rejected"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are names of the result")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = common.struct(*((c, common.id_type(docs, c)) for c in keep),
                           ("lang_pred", "string"), ("score", "double"), ("rejected", "boolean"))

    def run(batch: pa.RecordBatch) -> dict:
        known, found = held.value, []
        texts, letters = (batch.column(len(keep) + i).to_pylist() for i in (0, 1))
        for text, letter in zip(texts, letters):
            if not letter or not known.languages:
                found.append((NO_LANGUAGE, 0.0, False))
                continue
            best, cosine = known.nearest(text)
            found.append((known.languages[best], cosine, cosine < known.least[best]))
        languages, cosines, beyond = zip(*found) if found else ((), (), ())
        return {**dict(zip(keep, batch.columns)), "lang_pred": languages, "score": cosines, "rejected": beyond}

    text = F.col(text_col)
    return common.map_rows(docs.select(*keep, text.alias("_text"), has_letter(text).alias("_letter")), schema, run)


def held_out(id_col: Column, folds: int) -> Column:
    """Whether the hash of the id says that a row is not learned from; a missing id is not learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))
