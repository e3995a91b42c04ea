"""Benchmark decontamination by pigeonhole edit matching.

With a budget of k word edits, an item cut into k + 1 pieces leaves one of them
whole in any text that holds the item within the budget.  Pieces are found in one pass
by an automaton over the words of a text; around each hit, Myers' bit-parallel
algorithm finds the least edit distance of the item to any part of the text.
"""

from __future__ import annotations

import functools
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm import common
from reviewmill.sources.ship import ship

#: Edits allowed, as a share of the words of an item: a similarity of 0.8.
BUDGET = 0.2
#: Characters of items that are searched for in one pass over the documents; a worker's automaton takes
#: about 100 bytes for each.
BLOCK_CHARS = 2_500_000
_WORD = re.compile(r"\w+")
LEAK = "array<struct<item:bigint,edits:int,words:int,start_word:int,end_word:int>>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edit_budget(words: int, share: float = BUDGET) -> int:
    return int(words * share + 1e-9)


def pieces_of(words: list[str], budget: int) -> list[tuple[int, int]]:
    """(start, end) of budget + 1 pieces of about the same number of words."""
    count = budget + 1
    cuts = [len(words) * i // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


class Pattern:
    """Myers' algorithm for one sequence of words, forwards and backwards."""

    def __init__(self, words: list[str]):
        self.size = len(words)
        self._ahead = self._masks(words)
        self._back = self._masks(words[::-1])

    @staticmethod
    def _masks(words: list[str]) -> dict[str, int]:
        masks: dict[str, int] = {}
        for i, word in enumerate(words):
            masks[word] = masks.get(word, 0) | 1 << i
        return masks

    def _scores(self, masks: dict[str, int], text: list[str], anywhere: bool) -> Iterator[int]:
        """Least distance of the pattern to what ends at each word of the text.

        With `anywhere` a match may start at any word, else at the first.
        """
        full, last = (1 << self.size) - 1, 1 << self.size - 1
        up, down, score = full, 0, self.size
        for word in text:
            equal = masks.get(word, 0)
            vertical = equal | down
            diagonal = (((equal & up) + up) ^ up) | equal
            plus = down | ~(diagonal | up) & full
            minus = up & diagonal
            if plus & last:
                score += 1
            elif minus & last:
                score -= 1
            plus = (plus << 1 | (0 if anywhere else 1)) & full
            minus = minus << 1 & full
            up = minus | ~(vertical | plus) & full
            down = plus & vertical
            yield score

    def best(self, text: list[str], budget: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the first closest match, if the budget allows it."""
        least, end = self.size, 0
        for at, score in enumerate(self._scores(self._ahead, text, True), 1):
            if score < least:
                least, end = score, at
        if least > budget or not end:
            return None
        back = text[max(0, end - self.size - least):end][::-1]
        for length, score in enumerate(self._scores(self._back, back, False), 1):
            if score == least:
                return least, end - length, end
        return least, end, end


@dataclass
class Matcher:
    """Finds a block of items in texts."""

    items: list[tuple[int, list[str]]]
    share: float

    def __post_init__(self):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        self._patterns, self._budgets = [], []
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, words) in enumerate(self.items):
            budget = edit_budget(len(words), self.share)
            self._patterns.append(Pattern(words))
            self._budgets.append(budget)
            for start, end in pieces_of(words, budget):
                places.setdefault(f" {' '.join(words[start:end])} ", []).append((number, start))
        for piece, found in places.items():
            self._automaton.add_word(piece, (len(piece), found))
        self._some = bool(places)
        if self._some:
            self._automaton.make_automaton()

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, edits, words, start, end) of each item in the text, the closest place of it."""
        words = words_of(text)
        if not words or not self._some:
            return []
        joined = f" {' '.join(words)} "
        begins: list[int] = []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, found) in self._automaton.iter(joined):
            if not begins:
                at = 0
                for word in words:
                    begins.append(at)
                    at += len(word) + 1
            hit = bisect_left(begins, end - size + 1)
            for number, offset in found:
                budget = self._budgets[number]
                low = max(0, hit - offset - budget)
                high = min(len(words), hit - offset + self._patterns[number].size + budget)
                own = windows.setdefault(number, [])
                if own and low <= own[-1][1] and low >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        out = []
        for number, spans in windows.items():
            best, seen = None, {}
            for low, high in spans:
                part = words[low:high]
                key = tuple(part)
                if key not in seen:
                    seen[key] = self._patterns[number].best(part, self._budgets[number])
                if (got := seen[key]) and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1], low + got[2])
            if best:
                item, words_in = self.items[number]
                out.append((item, best[0], len(words_in), best[1], best[2]))
        return sorted(out)


#: The matcher that this Python worker used last, by the name of its block.
_MADE: dict[str, Matcher] = {}


def _matcher(block: str, items, share: float) -> Matcher:
    """The matcher of a block; tasks of one worker that search for the same block share it."""
    if block not in _MADE:
        _MADE.clear()
        _MADE[block] = Matcher(items.value, share)
    return _MADE[block]


def _texts(benchmark: DataFrame, item_text: str) -> DataFrame:
    """(text, number) of the distinct texts of the items."""
    texts = benchmark.where(F.length(item_text) > 0).select(F.col(item_text).alias("text")).distinct()
    return common.staged(texts.withColumn("number", F.monotonically_increasing_id()), "benchmark-texts")


def _blocks(texts: DataFrame, block_chars: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Numbers and words of the items, a bounded number of characters at a time."""
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_chars)
    for block in range(count):
        rows = texts.where(F.pmod(F.xxhash64("number"), F.lit(count)) == block).collect()
        yield [(r.number, w) for r in sorted(rows, key=lambda r: r.number) if (w := words_of(r.text))]


def _finder(shared, share: float):
    """An Arrow function from texts to the leaks of a broadcast block, by number of the item's text."""
    names, block = ("item", "edits", "words", "start_word", "end_word"), uuid.uuid4().hex
    kind = pa.list_(pa.struct([(n, pa.int64() if n == "item" else pa.int32()) for n in names]))

    @F.arrow_udf(LEAK)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from reviewmill.llm import decontaminate

        matcher = decontaminate._matcher(block, shared, share)
        for column in batches:
            yield pa.array(
                [[dict(zip(names, leak)) for leak in matcher.leaks(t)] for t in column.to_pylist()], kind)

    return find


def _found(docs: DataFrame, texts: DataFrame, share: float, block_chars: int, key: str,
           text_col: str) -> DataFrame | None:
    """(key, leak fields) of all documents and blocks; none without items.

    Of several blocks only one is broadcast at a time: its leaks are written before the next.
    """
    spark = docs.sparkSession
    ship(spark)
    made, blocks = [], _blocks(texts, block_chars)
    block = next(blocks, None)
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        found = docs.select(F.col(key).alias("_key"), F.inline(_finder(shared, share)(F.col(text_col))))
        block = next(blocks, None)
        if made or block is not None:
            found = common.staged(found, "leaks")
            shared.destroy()
        made.append(found)
    return functools.reduce(DataFrame.unionByName, made) if made else None


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = BUDGET,
          block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, edits, words, start_word, end_word): items that a text holds within the budget.

    Words are runs of letters, digits and underscores, compared in lower case;
    `edits` is the least number of words to insert, delete or replace, at most the
    floor of `share` of the item's `words`.  Places are word numbers in the text, the end
    exclusive, of the first closest match.  Items of less than 1 / share words have to
    match exactly; items without words match nothing, missing and empty texts hold
    nothing.  Repeated rows give repeated results, items of equal text each their own.
    Every text is read whole, once for each block of `block_chars` characters of items.
    """
    texts = _texts(benchmark, item_text)
    out = _found(docs, texts, share, block_chars, id_col, text_col)
    if out is None:
        empty = common.struct((id_col, common.id_type(docs, id_col)),
                              (item_col, common.id_type(benchmark, item_col)), ("edits", "int"),
                              ("words", "int"), ("start_word", "int"), ("end_word", "int"))
        return docs.sparkSession.createDataFrame([], empty)
    named = benchmark.select(F.col(item_col).alias("_item_id"), F.col(item_text).alias("text")).join(
        texts, "text").select("_item_id", "number")
    return out.join(named, F.col("item") == F.col("number")).select(
        F.col("_key").alias(id_col), F.col("_item_id").alias(item_col), "edits", "words",
        "start_word", "end_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = BUDGET,
                  block_chars: int = BLOCK_CHARS, text_col: str = "text",
                  item_text: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, whose text holds no item within the budget.

    With one block of items rows are judged where they are and nothing is shuffled; with more, rows are
    numbered, and the numbers of leaky ones collected block by block.  Missing and empty texts stay.
    """
    texts = _texts(benchmark, item_text)
    blocks = _blocks(texts, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        ship(docs.sparkSession)
        find: Column = _finder(docs.sparkSession.sparkContext.broadcast(first), share)(F.col(text_col))
        return docs.where(F.size(find) == 0)
    row = common.free(docs, "_row")
    rows = common.staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    bad = _found(rows, texts, share, block_chars, row, text_col).select(F.col("_key").alias(row)).distinct()
    return rows.join(bad, row, "left_anti").select(*docs.columns)
