"""SimHash near-duplicates: segment popcounts, a grid join under Manhattan distance, exact check.

A fingerprint of 64 bits is mapped to 32 bit counts, one for each segment of two
bits.  A flipped bit moves one count by one, so the Manhattan distance of two
count vectors is never above the Hamming distance of the fingerprints.  Vectors
within a distance of r differ in at most r of the G groups their coordinates
are dealt into, so they share a cell of the grid in one of the projections onto
G - r groups.  The join runs cell by cell on distinct fingerprints; a pair is
compared in the first of its shared projections only.  G grows with the number of
fingerprints, so that cells stay small.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm import common
from reviewmill.llm.components import components
from reviewmill.operators import duplicates

SEGMENTS = 32
#: Groups of segments, at least and at most, where none are asked for.
FEWEST, MOST = 8, 16
#: Comparisons that cost as much as a row sent to its cell, about.
_PER_ROW = 20
SEED = 42
_EVEN_BITS = 0x5555555555555555
#: Shingles whose bits are counted at once; bounds the memory a long text takes.
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of the word shingles; 0 for a text without words."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    count = max(1, len(words) - shingle + 1)
    starts = (ends - sizes)[:count].tolist()
    ends = ends[len(words) - count:].tolist()
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, _BLOCK):
        spans = zip(starts[at:at + _BLOCK], ends[at:at + _BLOCK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id",
                 text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, fingerprint) of every row; the fingerprint is a signed 64-bit number."""
    names = (id_col, *keep)
    schema = common.struct(*((n, common.id_type(docs, n)) for n in names), ("fingerprint", "bigint"))

    def run(batch: pa.RecordBatch) -> dict:
        found = [fingerprint(t, shingle) for t in common.binary(batch.column(len(names)))]
        return {**dict(zip(names, batch.columns)), "fingerprint": found}

    return common.map_rows(docs.select(*names, text_col), schema, run)


def _bytes(fp: Column) -> Column:
    """The fingerprint as eight bytes."""
    return F.unhex(F.lpad(F.hex(fp), 16, "0"))


def embed(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each again in two bits."""
    low = F.lit(_EVEN_BITS)
    high = F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(high).bitwiseAND(low)
    one = fp.bitwiseXOR(high).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(one)


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed vectors of counts from 0 to 2."""
    low = F.lit(_EVEN_BITS)
    differ = a.bitwiseXOR(b)
    by_one = differ.bitwiseAND(low)
    by_two = F.shiftrightunsigned(differ, 1).bitwiseAND(low).bitwiseAND(F.bitwise_not(by_one))
    return F.bit_count(by_one) + 2 * F.bit_count(by_two)


def _dealt(groups: int) -> list[int]:
    """Mask of the bits of each group: the segments in order, as evenly as can be."""
    cuts = [g * SEGMENTS // groups for g in range(groups + 1)]
    return [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(cuts, cuts[1:])]


def _projections(groups: int, distance: int) -> list[tuple[int, int]]:
    """Of each choice of groups: its mask, and flags of the skipped groups before its last."""
    masks = _dealt(groups)
    chosen = itertools.combinations(range(groups), groups - distance)
    return [
        (sum(masks[g] for g in own), sum(1 << g for g in range(max(own)) if g not in own))
        for own in chosen
    ]


def groups_for(rows: int, distance: int) -> int:
    """The number of groups with the least work for so many distinct fingerprints.

    Counts of a segment of even bits agree with a chance of 3/8.  More groups send a
    fingerprint to more cells, each of which it shares with fewer others.
    """
    def work(groups: int) -> float:
        shared = SEGMENTS * (groups - distance) // groups
        return math.comb(groups, distance) * (1 + rows * (3 / 8) ** shared / _PER_ROW)

    return min(range(max(FEWEST, distance + 1), max(MOST, distance + 1) + 1), key=work)


def links(distinct: DataFrame, distance: int, groups: int | None = None) -> DataFrame:
    """(a, b) with a < b for all pairs of the distinct fingerprints within the distance.

    More groups make smaller cells and more of them; by default their number follows
    that of the fingerprints, which are counted.  The result is the same for every choice.
    """
    groups = groups or groups_for(distinct.count(), distance)
    if not distance < groups <= SEGMENTS:
        raise ValueError("groups must exceed the distance and not the number of segments")
    masks, skipped = zip(*_projections(groups, distance))
    e = embed(F.col("fingerprint"))
    cells = distinct.select(
        "fingerprint", F.posexplode(F.transform(common.literal_longs(masks), e.bitwiseAND))
        .alias("projection", "cell"))
    # Many rows for each fingerprint, which the planner does not count: it would broadcast them.
    a, b = cells.alias("a"), cells.hint("merge").alias("b")
    x, y = F.col("a.fingerprint"), F.col("b.fingerprint")
    differ = embed(x).bitwiseXOR(embed(y))
    before = F.element_at(common.literal_longs(skipped), F.col("a.projection") + 1)
    # The first shared projection: each group that it skips before its last one differs.
    first_shared = F.lit(True)
    for g, mask in enumerate(_dealt(groups)):
        own = common.literal_long(mask)
        first_shared &= (before.bitwiseAND(F.lit(1 << g)) == 0) | (differ.bitwiseAND(own) != 0)
    return a.join(
        b,
        (F.col("a.projection") == F.col("b.projection")) & (F.col("a.cell") == F.col("b.cell"))
        & (x < y) & (manhattan(embed(x), embed(y)) <= distance)
        & (F.bit_count(x.bitwiseXOR(y)) <= distance) & first_shared,
    ).select(x.alias("a"), y.alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, groups: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of `docs`.

    Rows belong together if a chain of fingerprints within `distance` bits joins
    them; component_id is the smallest id of theirs.  A missing or empty text and one
    without words has fingerprint 0 and is linked like any other.  Repeated rows
    give repeated results; a missing id never is the smallest.  Other columns of
    `docs` are left out.  An empty table gives an empty table.
    """
    prints = fingerprints(docs, shingle, id_col, text_col)
    every = common.staged(prints.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    classes = common.staged(every.groupBy("fingerprint").agg(
        F.min(id_col).alias("_first"), F.count("*").alias("copies")), "fingerprint-classes")
    roots = components(links(classes.select("fingerprint"), distance, groups))
    linked = classes.join(roots, F.col("fingerprint") == F.col("node"))
    firsts = linked.groupBy("root").agg(F.min("_first").alias("_least"))
    joined = linked.join(firsts, "root").select(F.col("fingerprint").alias("_linked"), "_least")
    least = classes.join(joined, F.col("fingerprint") == F.col("_linked"), "left").select(
        _bytes(F.col("fingerprint")).alias("dup_key"),
        F.when(F.col("_linked").isNull(), F.col("_first")).otherwise(F.col("_least")).alias("first_id"),
        "copies")
    # Fingerprints of most rows are broadcast, so that their rows are dealt out.
    found = duplicates.attach_groups(
        every.withColumn("_key", _bytes(F.col("fingerprint"))), common.staged(least, "fingerprint-groups"),
        "_key", row_id="_row")
    return found.select(id_col, "fingerprint", F.col("_first_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4, groups: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each group: the first with the smallest id; without any id, the first.

    All columns are kept.  Ids need not differ or be there: rows are told apart by a number.
    The leaders grow with the documents, so they are never broadcast: rows meet them
    in one shuffle, whatever the size.
    """
    row = common.free(docs, "_row")
    # Written with their numbers, so that they are the same whenever rows are read.
    rows = common.staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    own = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row).alias("row"))
    classes = common.staged(
        fingerprints(rows, shingle, id_col, text_col, (row,)).groupBy("fingerprint")
        .agg(F.min(own).alias("_first")), "fingerprint-firsts")
    roots = components(links(classes.select("fingerprint"), distance, groups))
    leaders = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").groupBy(
        F.coalesce("root", "fingerprint").alias("_group")).agg(F.min("_first").alias("_least"))
    leaders = common.staged(leaders.select(F.col("_least.row").alias(row)), "leaders")
    return rows.join(leaders.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
