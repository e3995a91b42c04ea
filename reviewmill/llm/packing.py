"""Best-fit packing of tokenized documents by large-item matching.

Pieces longer than a third of the capacity share a sequence with at most one more
of their kind; a greedy matching gives each, from the longest down, the longest
partner that fits.  Shorter pieces then go, from the longest down, where the
smallest gap takes them.  Pieces of one length are alike, so the plan is made from
the number of pieces of each length, which has no more rows than the capacity, and
pieces take their places by their number among those of their length.
"""

from __future__ import annotations

import base64
import bisect
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reviewmill.llm import common
from reviewmill.sources.ship import ship

CAPACITY = 2048
#: Texts whose ids a task holds at once.
_SLICE = 1_000


@dataclass(frozen=True)
class Slot:
    """Places for pieces of one length, numbered from `first` up to `last` (exclusive).

    `copies` of them stand one after the other from `offset` in each sequence from `sequence` on.
    """

    length: int
    first: int
    last: int
    sequence: int
    copies: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Slots for so many pieces of each length; lengths are between 1 and the capacity."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    slots: list[Slot] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    sizes: list[int] = []  # the gaps there are, in order
    sequences = 0

    def open_gap(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(sizes, gap)
            gaps.setdefault(gap, []).append((first, count))

    def take(length: int, sequence: int, bins: int, copies: int, gap: int) -> None:
        count = bins * copies
        slots.append(Slot(length, used[length], used[length] + count, sequence, copies, capacity - gap))
        used[length] += count
        left[length] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        if not left[longest]:
            large.pop()
            continue
        fit = bisect.bisect_right(large, min(capacity - longest, longest)) - 1
        while fit >= 0 and (not left[large[fit]] or large[fit] == longest and left[longest] < 2):
            fit -= 1
        if fit < 0:
            bins = left[longest]
            take(longest, sequences, bins, 1, capacity)
            open_gap(capacity - longest, sequences, bins)
        else:
            partner = large[fit]
            same = partner == longest
            bins = left[longest] // 2 if same else min(left[longest], left[partner])
            take(longest, sequences, bins, 1, capacity)
            take(partner, sequences, bins, 1, capacity - longest)
            open_gap(capacity - longest - partner, sequences, bins)
        sequences += bins
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                bins = -(-left[length] // (capacity // length))
                open_gap(capacity, sequences, bins)
                sequences += bins
                continue
            gap = sizes[at]
            first, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            copies = gap // length
            full = min(bins, left[length] // copies)
            if full:
                take(length, first, full, copies, gap)
                open_gap(gap - copies * length, first, full)
            if full < bins:
                rest = left[length]
                if rest:
                    take(length, first + full, 1, rest, gap)
                    open_gap(gap - rest * length, first + full, 1)
                open_gap(gap, first + full + bool(rest), bins - full - bool(rest))
    return slots


class Encoder:
    """Ids of byte_bpe_50k, as the tokenizer file gives them without special tokens around a text.

    Texts that hold the string of an added token go through the tokenizer itself, which gives that token's id.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as file:
            self._added = [t["content"] for t in json.load(file)["added_tokens"]]
        self._json_path = json_path
        self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._plain = None

    def ids(self, text: str) -> list[int]:
        if any(token in text for token in self._added):
            return self._slow(text)
        try:
            return self._fast.encode_ordinary(text)
        except BaseException as error:  # a panic of the extension, on texts it cannot split
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            return self._slow(text)

    def starts_word(self, token: int) -> bool:
        """The id stands for text that begins with a space."""
        return self._fast.decode_single_token_bytes(token).startswith(b" ")

    def _slow(self, text: str) -> list[int]:
        if self._plain is None:
            from tokenizers import Tokenizer

            self._plain = Tokenizer.from_file(self._json_path)
        return self._plain.encode(text, add_special_tokens=False).ids


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first takes what is over."""
    first = len(ids) % capacity or min(len(ids), capacity)
    starts = [0, *range(first, len(ids), capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(ids)])]


def tokenized(docs: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k",
              end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids, chunk, nth) of every row, written to the shared folder.

    `ids` are little-endian unsigned 32-bit numbers.  A missing or empty text is one
    piece with the end id alone.  Only documents above the capacity are cut.  `chunk`
    names the task that made a piece and `nth` numbers its pieces of one length.
    """
    ship(docs.sparkSession)
    schema = common.struct(
        (id_col, common.id_type(docs, id_col)), ("piece", "int"), ("start", "bigint"),
        ("length", "bigint"), ("ids", "binary"), ("chunk", "bigint"), ("nth", "bigint"))

    def run(batches):
        import public_tokenizers

        encoder = Encoder(public_tokenizers.path(f"{name}.json"),
                          public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)
        chunk = TaskContext.get().taskAttemptId()
        made = np.zeros(capacity + 1, np.int64)
        for batch in (b.slice(at, _SLICE) for b in batches for at in range(0, b.num_rows, _SLICE)):
            rows: list[list] = [[], [], [], [], [], []]
            of_row = []
            for number, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encoder.ids(text or ""), end_id], "<u4")
                for piece, (start, length) in enumerate(pieces_of(ids, capacity)):
                    of_row.append(number)
                    for values, value in zip(rows, (
                            piece, start, length, ids[start:start + length].tobytes(), chunk,
                            int(made[length]))):
                        values.append(value)
                    made[length] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of_row, pa.int64())),
                 *(pa.array(v, k) for v, k in zip(rows, kinds))], schema.names)

    return common.staged(docs.select(id_col, text_col).mapInArrow(run, schema), "token-pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of `pieces` but chunk and nth, with sequence_id and offset.

    `pieces` has length, chunk and nth as `tokenized` makes them.  The driver sees
    one number for each length.
    """
    spark = pieces.sparkSession
    counts = common.staged(
        pieces.groupBy("length", "chunk").agg(F.max("nth").alias("most")), "piece-counts")
    lengths = counts.groupBy("length").agg(F.sum(F.col("most") + 1).alias("n")).collect()
    by_length: dict[int, list[tuple]] = {}
    for s in plan({r.length: r.n for r in lengths}, capacity):
        by_length.setdefault(s.length, []).append((s.first, s.last, s.sequence, s.copies, s.offset))
    # How many slots there are depends on the lengths there can be, not on the number of pieces.
    slots = F.broadcast(spark.createDataFrame(
        list(by_length.items()), "length long, "
        "slots array<struct<first:long,last:long,sequence:long,copies:long,offset:long>>"))
    # Places of a chunk are one range of numbers; each slot that meets it becomes a row.
    in_order = F.expr("sum(most + 1) OVER (PARTITION BY length ORDER BY chunk "
                      "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - most - 1")
    ranges = counts.withColumn("base", in_order)
    met = ranges.join(slots, "length").select(
        F.col("length").alias("_length"), F.col("chunk").alias("_chunk"), "base", F.expr(
            "inline(filter(slots, s -> s.first <= base + most AND s.last > base))"
        )).withColumnRenamed("offset", "_offset")
    met = common.staged(met, "piece-places")
    number = F.col("base") + F.col("nth") - F.col("first")
    joined = pieces.join(
        met, (F.col("length") == F.col("_length")) & (F.col("chunk") == F.col("_chunk"))
        & (F.col("base") + F.col("nth") >= F.col("first"))
        & (F.col("base") + F.col("nth") < F.col("last")))
    kept = [c for c in pieces.columns if c not in ("chunk", "nth")]
    return joined.select(
        *kept, (F.col("sequence") + F.floor(number / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(number, F.col("copies")) * F.col("length")).alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset): every token of every row in one place.

    Sequences have no gaps before their last token and none is longer than the
    capacity.  Repeated rows are packed again; other columns are left out; an empty
    table gives none.
    """
    return place(tokenized(docs, capacity, id_col=id_col, text_col=text_col), capacity)
