"""Quality rules: a decision list learned from labelled statistics of texts.

Sequential covering: a rule is grown on two thirds of the rows that are still
uncovered, one threshold condition at a time by information gain, and pruned on the
last third; rules are added as long as they hold up there.  The list becomes
one conditional expression of Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm import common

#: Labelled rows that a list is learned from, at most; drawn by the hash of their ids.
SAMPLE_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_chars")
_SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
_SPACE = " \t\n\x0b\x0c\r"
_MARKS = [bytes([c]) for c in b"!?|;"]
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def _repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of `size` words found more than once."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    seen: set = set()
    again = set()
    for w in windows:
        if w in seen:
            again.add(w)
        else:
            seen.add(w)
    if not again:
        return 0
    covered, reach = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + size - max(i, reach)
            reach = i + size
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS and MORE; a missing text is empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # ASCII white space only
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(raw.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated_words(words),
        len(lines),
        len(set(words)),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _DIGITS)),
        sum(map(raw.count, _MARKS)),
        len(text),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, MORE) of every whole text; other columns are left out."""
    names = COUNTS + MORE
    schema = common.struct((id_col, common.id_type(docs, id_col)), *((n, "bigint") for n in names))

    def run(batch: pa.RecordBatch) -> dict:
        rows = np.array([measure(t) for t in batch.column(1).to_pylist()], np.int64)
        columns = rows.reshape(-1, len(names)).T
        return {id_col: batch.column(0), **{n: pa.array(c) for n, c in zip(names, columns)}}

    return common.map_rows(docs.select(id_col, text_col), schema, run)


def features() -> dict[str, Column]:
    """What rules look at, from the counts; no division by nothing."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "marks_per_word": F.col("n_marks") / words,
        "duplicate_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / words,
        "distinct_words": F.col("n_distinct") / words,
        "upper_letters": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "word_length": F.col("word_chars") / words,
        "words_per_line": F.col("n_words") / lines,
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        x = columns[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def expression(self) -> Column:
        x = F.col(self.feature)
        return x > self.threshold if self.above else x <= self.threshold


Rule = tuple[Condition, ...]


def _tightest(rule: Rule) -> Rule:
    """The rule without conditions that another one of it implies."""
    def implied(c: Condition) -> bool:
        return any(c.feature == o.feature and c.above == o.above and c != o
                   and (o.threshold > c.threshold) == c.above for o in rule)

    return tuple(c for c in dict.fromkeys(rule) if not implied(c))


def _covers(rule: Rule, columns: dict[str, np.ndarray], size: int) -> np.ndarray:
    held = np.ones(size, bool)
    for condition in rule:
        held &= condition.holds(columns)
    return held


def _best(columns: dict, bad: np.ndarray, at: np.ndarray, steps: int) -> tuple[float, Condition | None]:
    """The condition that gains most information about the bad rows among those in `at`."""
    p0, n0 = bad[at].sum(), (~bad[at]).sum()
    if not p0 or not n0:
        return 0.0, None
    before = np.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (1e-9, None)
    for name, column in columns.items():
        x = column[at]
        cuts = np.unique(np.quantile(x, np.linspace(0, 1, steps + 1)[:-1], method="lower"))
        order = np.sort(x)
        order_bad = np.sort(x[bad[at]])
        for cut in cuts:
            total, hit = np.searchsorted(order, cut, "right"), np.searchsorted(order_bad, cut, "right")
            for above in (False, True):
                p = p0 - hit if above else hit
                t = len(x) - total if above else total
                if p and t < len(x):
                    gain = p * (np.log2(p / t) - before)
                    if gain > best[0]:
                        best = (gain, Condition(name, above, float(cut)))
    return best


def _worth(rule: Rule, columns: dict, bad: np.ndarray) -> tuple[float, int, int]:
    held = _covers(rule, columns, len(bad))
    p, n = int(bad[held].sum()), int((~bad[held]).sum())
    return (p - n) / (p + n) if p + n else -1.0, p, n


def learn(columns: dict[str, np.ndarray], bad: np.ndarray, folds: np.ndarray,
          least_precision: float = 0.9, most_rules: int = 16, most_conditions: int = 4,
          steps: int = 64) -> list[Rule]:
    """Ordered rules for the bad rows; `folds` has 0, 1 or 2 for every row, 2 to prune on.

    Without bad rows or without good rows the list is empty.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        grow, prune = left & (folds < 2), left & (folds == 2)
        rule: Rule = ()
        at = grow.copy()
        while len(rule) < most_conditions and at.any():
            _, condition = _best(columns, bad, at, steps)
            if condition is None:
                break
            rule += (condition,)
            at &= condition.holds(columns)
        held_out = {n: c[prune] for n, c in columns.items()}
        tails = [rule[:i] for i in range(1, len(rule) + 1)]
        if not tails:
            break
        worth = [_worth(t, held_out, bad[prune]) for t in tails]
        pick = max(range(len(tails)), key=lambda i: (worth[i][0], -i))
        _, p, n = worth[pick]
        if p < 2 or p / (p + n) < least_precision:
            break
        rules.append(_tightest(tails[pick]))
        left &= ~_covers(tails[pick], columns, len(bad))
    return rules


def expression(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    number = None
    for i, rule in enumerate(rules, 1):
        held = F.lit(True)
        for condition in rule:
            held &= condition.expression()
        number = F.when(held, i) if number is None else number.when(held, i)
    return F.lit(0) if number is None else number.otherwise(0)


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
        id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """A list learned from the statistics of labelled rows; label 0 is bad, rows without label are out.

    At most `sample_rows` rows are used, those with the smallest hashes of their ids.
    """
    made = features()
    known = labels.where(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).alias("_label"))
    rows = stats.join(known, id_col).select(
        F.xxhash64(id_col).alias("_draw"), (F.col("_label") == 0).alias("_bad"),
        *(x.alias(n) for n, x in made.items()))
    drawn = rows.orderBy("_draw", *made, "_bad").limit(sample_rows).toPandas()
    columns = {n: drawn[n].to_numpy(float) for n in made}
    return learn(columns, drawn["_bad"].to_numpy(bool), (drawn["_draw"].to_numpy(np.int64) >> 7) % 3)


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, base_failed, kept, rule) of every row of `docs`.

    `base_failed`: fewer than 10 words, or more than a fifth of the words in
    repeated windows of five.  `kept` is false for those and for rows on which a
    learned rule holds; `rule` is the number of that rule, 0 if none does.  A list has at most 16
    rules of 4 conditions, whose thresholds are among 64 quantiles of the labelled rows (`learn`); that
    bounds the model, not the rows.
    A missing or empty text has no words and fails.  Repeated rows give repeated
    results.  Without usable labels the list is empty and only the base counts.
    """
    stats = common.staged(statistics(docs, id_col, text_col), "text-statistics")
    rule = expression(fit(stats, labels, sample_rows, id_col))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    made = features()
    extra = {n: x for n, x in made.items() if n not in COUNTS}
    return (
        stats.withColumn("base_failed", failed).withColumns(extra).withColumn("rule", rule)
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
        .select(id_col, *COUNTS, "base_failed", "kept", "rule")
    )
