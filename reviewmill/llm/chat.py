"""Transcript parsing: a hidden Markov model recovers who speaks, line by line.

A transcript is the rows of a conversation in order, their texts cut into lines.
Hidden are the role of a line and whether a turn begins there; seen are the role given with the row, which
decides, or else the speaker marker that the line starts with, the first line of a row,
questions, lists and length.  The model is counted from the rows with a known role, also
how often a text of each role starts with the marker of each; where roles are missing, it is counted
once more from all rows with the roles it gives them.

Transcripts may be of any length: rows are dealt out by ranges of (conversation,
turn), so a long one lies in several parts.  Each part gives the best scores from
every state at its start to every state at its end; the few conversations that cross
parts are joined from these, and each part is then decoded on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewmill.llm import common
from reviewmill.sources.ship import ship

ROLES = ("user", "assistant", "system")
#: Names of speakers.
_NAMES = {
    "user": "user human customer client person prompter question q you me".split(),
    "assistant": "assistant ai bot model chatbot agent answer a gpt response".split(),
    "system": "system instruction instructions context developer".split(),
}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in _NAMES[role]}
_MARKER = re.compile(
    r"\s*(?:<\|(?:im_start\|>)?|\[|#{1,4}\s*|\*{1,2}|-{2,}\s*)?\s*"
    r"(?P<name>[A-Za-z]{1,12})\s*(?:\|>|\]|\*{0,2}\s*:\s*\*{0,2}|>)\s*")
NONE, OTHER = len(ROLES), len(ROLES) + 1
#: Signs of a line: first of a row of each role, or of a row without one by marker, or a later one by marker.
_GIVEN, _MARKERS, _LENGTHS = len(ROLES), len(ROLES) + 1, 4
_SIGNS = _GIVEN + 2 * _MARKERS
#: Codes of a line: sign, question, list, length.
CODES = _SIGNS * 2 * 2 * _LENGTHS
#: How often a text was seen beforehand with its own marker, without one, and with that of another role.
_PRIOR = (1.0, 1.0, 0.02)
#: Characters in a part, about: a task holds one part at a time.
PART_CHARS = 64_000_000
#: States: the first line of a turn of each role, then its other lines.
STATES = 2 * len(ROLES)
_NEVER = -1e9


def role_number(name: str | None) -> int:
    name = (name or "").strip().lower()
    return _ROLE_OF.get(name, OTHER if name else NONE)


def _marker(line: str) -> tuple[int, int]:
    """Role that a line's start names, and where its text begins."""
    found = _MARKER.match(line)
    if found and (role := _ROLE_OF.get(found["name"].lower())) is not None:
        return role, found.end()
    return NONE, 0


def line_code(line: str, first: bool, declared: int) -> int:
    if first and declared < len(ROLES):
        sign = declared
    else:
        sign = _GIVEN + _MARKERS * (not first) + _marker(line)[0]
    length = 0 if not line.strip() else 1 if len(line) < 40 else 2 if len(line) < 160 else 3
    listed = line.lstrip()[:2] in ("- ", "* ", "``") or line.lstrip()[:1].isdigit()
    return ((sign * 2 + line.rstrip().endswith("?")) * 2 + listed) * _LENGTHS + length


def row_codes(text: str | None, declared: int) -> bytes:
    return bytes(line_code(x, i == 0, declared) for i, x in enumerate((text or "").split("\n")))


def _said(line: str, role: int) -> str:
    """A line that begins a turn without its marker; the marker of another role is part of the text."""
    marker, at = _marker(line)
    return line[at:] if marker == role else line


def _parts(code: np.ndarray) -> tuple[np.ndarray, ...]:
    length, code = code % _LENGTHS, code // _LENGTHS
    listed, code = code % 2, code // 2
    return code // 2, code % 2, listed, length


@dataclass
class Model:
    """Logarithms: of each code in each state, of the first state, of each state after another."""

    emit: np.ndarray
    begin: np.ndarray
    step: np.ndarray


def model(codes: np.ndarray, begins: np.ndarray, steps: np.ndarray, markers: np.ndarray) -> Model:
    """From counts by (state, code), by first role, by (role, next role) and by (role, marker of its text)."""
    roles = len(ROLES)
    sign, question, listed, length = _parts(np.arange(CODES))
    emit = np.zeros((STATES, CODES))
    for values, size in ((question, 2), (listed, 2), (length, _LENGTHS)):
        table = np.ones((STATES, size))
        for state in range(STATES):
            np.add.at(table[state], values, codes[state])
        table = np.log(table / table.sum(axis=1, keepdims=True))
        emit += table[:, values]
    own, none, other = _PRIOR
    written = np.full((roles, _MARKERS), other) + own * np.eye(roles, _MARKERS)
    written[:, NONE] = none
    written += markers
    written = np.log(written / written.sum(axis=1, keepdims=True))
    for state in range(STATES):
        role, starts = state % roles, state < roles
        for value in range(_SIGNS):
            marker = (value - _GIVEN) % _MARKERS
            if value < _GIVEN:  # a role that is given decides
                p = 0.0 if starts and value == role else _NEVER
            elif value < _GIVEN + _MARKERS:
                p = written[role, marker] if starts else _NEVER
            elif starts:  # a turn inside a row has its marker
                p = np.log(0.05) if marker == role else np.log(1e-6)
            else:
                p = np.log(0.9) if marker == NONE else np.log(1e-3)
            emit[state, sign == value] += p
    begin = np.full(STATES, _NEVER)
    begin[:roles] = np.log((begins + 1) / (begins + 1).sum())
    lines = codes.sum(axis=1)
    ends = max(lines[:roles].sum(), 1) / max(lines.sum(), 1)  # a line that ends its turn
    follow = np.log((steps + 1) / (steps + 1).sum(axis=1, keepdims=True))
    step = np.full((STATES, STATES), _NEVER)
    for state in range(STATES):
        step[state, :roles] = np.log(min(max(ends, 1e-3), 0.999)) + follow[state % roles]
        step[state, roles + state % roles] = np.log(1 - min(max(ends, 1e-3), 0.999))
    return Model(emit, begin, step)


def scores(m: Model, codes: bytes, entry: np.ndarray | None) -> np.ndarray:
    """Best scores to each state at the last line; with a matrix `entry`, from each row of it."""
    now = None if entry is None else entry
    for at, code in enumerate(codes):
        if now is None:
            now = m.begin + m.emit[:, code]
        else:
            now = (now[..., :, None] + m.step).max(axis=-2) + m.emit[:, code]
    return now


def decode(m: Model, codes: bytes, entry: np.ndarray | None, last: int | None) -> np.ndarray:
    """Best states of the lines, after `entry` and ending in `last` if they are given."""
    size = len(codes)
    back = np.zeros((size, STATES), np.uint8)
    now = entry
    for at, code in enumerate(codes):
        if now is None:
            now = m.begin + m.emit[:, code]
            continue
        ways = now[:, None] + m.step
        back[at] = ways.argmax(axis=0)
        now = ways.max(axis=0) + m.emit[:, code]
    states = np.zeros(size, np.uint8)
    states[-1] = now.argmax() if last is None else last
    for at in range(size - 1, 0, -1):
        states[at - 1] = back[at, states[at]]
    return states


def _ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
             parts: int) -> DataFrame:
    """Rows dealt out by ranges of (conversation, turn) and numbered in order, with codes of lines."""
    schema = common.struct(
        ("conv", common.id_type(rows, conv_col)), ("turn", common.id_type(rows, turn_col)),
        ("text", "string"), ("role", "tinyint"), ("marker", "tinyint"), ("codes", "binary"))

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(3).to_pylist()
        roles = [role_number(r) for r in batch.column(2).to_pylist()]
        return {"conv": batch.column(0), "turn": batch.column(1), "text": batch.column(3),
                "role": pa.array(roles, pa.int8()),
                "marker": pa.array([_marker((t or "").split("\n", 1)[0])[0] for t in texts], pa.int8()),
                "codes": pa.array([row_codes(t, r) for t, r in zip(texts, roles)], pa.binary())}

    coded = common.map_rows(rows.select(conv_col, turn_col, role_col, text_col), schema, run)
    order = ("conv", "turn", "role", "tie")
    tied = coded.withColumn("tie", F.xxhash64("text"))
    dealt = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    return common.staged(
        dealt.withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id()), "transcript-rows")


def _runs(convs: list, codes: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(first row, row after the last, codes of all lines) of each conversation in a part."""
    out, start = [], 0
    for at in range(1, len(convs) + 1):
        if at == len(convs) or convs[at] != convs[start]:
            out.append((start, at, b"".join(codes[start:at])))
            start = at
    return out


def _counted(ordered: DataFrame) -> Model:
    """The model from all rows; each part gives one row of counts and the roles at its ends."""
    roles = len(ROLES)
    kind = common.id_type(ordered, "conv")
    schema = common.struct(
        ("part", "int"), ("counts", "array<bigint>"), ("first_conv", kind), ("last_conv", kind),
        ("first_role", "int"), ("last_role", "int"))

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        convs, given = table["conv"].to_pylist(), table["role"].to_pylist()
        seen, begins = np.zeros((STATES, CODES), np.int64), np.zeros(roles, np.int64)
        steps, markers = np.zeros((roles, roles), np.int64), np.zeros((roles, _MARKERS), np.int64)
        written = table["marker"].to_pylist()
        for at, (role, codes) in enumerate(zip(given, table["codes"].to_pylist())):
            if role >= roles:
                continue
            markers[role, written[at]] += 1
            seen[role, codes[0]] += 1
            seen[roles + role] += np.bincount(np.frombuffer(codes[1:], np.uint8), minlength=CODES)
            if at and convs[at - 1] == convs[at]:
                if given[at - 1] < roles:
                    steps[given[at - 1], role] += 1
            elif at:
                begins[role] += 1
        counts = np.concatenate([seen.ravel(), begins, steps.ravel(), markers.ravel()]).tolist()
        return pa.table({
            "part": [table["part"][0].as_py()], "counts": [counts],
            "first_conv": table["conv"].slice(0, 1),
            "last_conv": table["conv"].slice(len(convs) - 1, 1),
            "first_role": pa.array([given[0]], pa.int32()),
            "last_role": pa.array([given[-1]], pa.int32())}).cast(arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ends = ordered.select("part", "place", "conv", "role", "marker", "codes").groupBy("part").applyInArrow(
        count, schema)
    ends = common.staged(ends, "transcript-counts")
    summed = ends.select(F.posexplode("counts").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    cuts = np.cumsum([0, STATES * CODES, roles, roles * roles, roles * _MARKERS])
    total = np.zeros(cuts[-1], np.int64)
    for r in summed.collect():
        total[r.i] = r.n
    seen, begins, steps, markers = (total[a:b].copy() for a, b in zip(cuts, cuts[1:]))
    steps = steps.reshape(roles, roles)
    before = None
    for r in sorted(ends.drop("counts").collect(), key=lambda r: r.part):  # one row for each part
        if r.first_role < roles:
            if before is None or before.last_conv != r.first_conv:
                begins[r.first_role] += 1
            elif before.last_role < roles:
                steps[before.last_role, r.first_role] += 1
        before = r
    return model(seen.reshape(STATES, CODES), begins, steps, markers.reshape(roles, _MARKERS))


def _crossings(ordered: DataFrame, m: Model) -> dict[int, tuple]:
    """For each part: scores its first conversation starts with, states its first and last end in.

    The driver sees the first and the last conversation of each part only.
    """
    kind = common.id_type(ordered, "conv")
    schema = common.struct(("part", "int"), ("first_conv", kind), ("last_conv", kind),
                           ("whole", "boolean"), ("through", "array<double>"), ("tail", "array<double>"))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    unit = np.where(np.eye(STATES, dtype=bool), 0.0, _NEVER)

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        runs = _runs(table["conv"].to_pylist(), table["codes"].to_pylist())
        through = scores(m, runs[0][2], unit).ravel().tolist()
        tail = scores(m, runs[-1][2], None).tolist()
        last = len(table) - 1
        return pa.table({
            "part": [table["part"][0].as_py()], "first_conv": table["conv"].slice(0, 1),
            "last_conv": table["conv"].slice(last, 1), "whole": [len(runs) == 1],
            "through": [through], "tail": [tail]}).cast(arrow)

    rows = ordered.select("part", "place", "conv", "codes").groupBy("part").applyInArrow(ends, schema)
    rows = sorted(rows.collect(), key=lambda r: r.part)
    entry: dict[int, np.ndarray | None] = {}
    out_score: dict[int, np.ndarray] = {}
    for i, r in enumerate(rows):  # forward: scores at the end of each part's last conversation
        joined = i > 0 and rows[i - 1].last_conv == r.first_conv
        entry[i] = out_score[i - 1] if joined else None
        if r.whole and joined:
            out_score[i] = (entry[i][:, None] + np.reshape(r.through, (STATES, STATES))).max(axis=0)
        else:
            out_score[i] = np.array(r.tail)
    found: dict[int, tuple] = {}
    state_after = None  # state in which the conversation must leave the part before
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        last_state = state_after
        first_state = last_state if r.whole else None
        state_after = None
        if entry[i] is not None:
            ways = entry[i][:, None] + np.reshape(r.through, (STATES, STATES))
            final = first_state if first_state is not None else int(ways.max(axis=0).argmax())
            first_state = final
            state_after = int(ways[:, final].argmax())
        found[r.part] = (entry[i], first_state, last_state)
    return found


def _states(table: pa.Table, m: Model, border: tuple) -> list[np.ndarray]:
    """Best states of the lines of each row of a part, whose rows are in order."""
    codes = table["codes"].to_pylist()
    runs = _runs(table["conv"].to_pylist(), codes)
    entry, first_state, last_state = border
    out = []
    for number, (low, high, lines) in enumerate(runs):
        last = last_state if number == len(runs) - 1 else None
        if number == 0 and first_state is not None:
            last = first_state
        states = decode(m, lines, entry if number == 0 else None, last)
        out += np.split(states, np.cumsum([len(c) for c in codes[low:high]])[:-1])
    return out


def _filled(ordered: DataFrame, m: Model) -> DataFrame:
    """The rows with the roles that the model gives their first lines, to be counted again."""
    borders = ordered.sparkSession.sparkContext.broadcast(_crossings(ordered, m))
    schema = common.struct(("part", "int"), ("place", "bigint"), ("conv", common.id_type(ordered, "conv")),
                           ("role", "tinyint"), ("marker", "tinyint"), ("codes", "binary"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        found = _states(table, m, borders.value[table["part"][0].as_py()])
        roles = pa.array([int(s[0]) % len(ROLES) for s in found], pa.int8())
        return table.set_column(table.column_names.index("role"), "role", roles)

    names = ("part", "place", "conv", "role", "marker", "codes")
    return common.staged(
        ordered.select(*names).groupBy("part").applyInArrow(fill, schema), "transcript-roles")


def learned(ordered: DataFrame) -> Model:
    """The model of the known roles; where some are missing, counted again with those it gives them."""
    m = _counted(ordered)
    if ordered.where(F.col("role") >= len(ROLES)).isEmpty():
        return m
    return _counted(_filled(ordered, m))


def render(role: str, text: str) -> str:
    """A turn in its canonical form."""
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def parse(rows: DataFrame, parts: int | None = None, conv_col: str = "conv_id",
          turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, turn, piece, role, text, rendered): the turns found in each row of `rows`.

    A row begins a turn; a speaker marker inside its text may begin another, so `piece`
    numbers the turns of a row from 0.  A known role given with a row is the role of its first line,
    whatever the text starts with; where it is missing or unknown, the model decides.
    `text` is the turn without its marker; the marker of another role is part of the text.  A missing or empty text is an empty turn.
    Rows with equal turn are ordered by role and text; rows without conversation are
    one conversation, repeated rows are turns of their own.  Other columns are left
    out.  With no known role the model knows markers only.  `parts` is the number of
    ranges that rows are dealt into, by default enough for PART_CHARS characters in each.
    """
    spark = rows.sparkSession
    ship(spark)
    if not parts:
        chars = rows.agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("bigint") + 16)).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    ordered = _ordered(rows, conv_col, turn_col, role_col, text_col, parts)
    m = learned(ordered)
    borders = spark.sparkContext.broadcast(_crossings(ordered, m))
    schema = common.struct(
        (conv_col, common.id_type(rows, conv_col)), (turn_col, common.id_type(rows, turn_col)),
        ("piece", "int"), ("role", "string"), ("text", "string"), ("rendered", "string"))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def turns(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        states = _states(table, m, borders.value[table["part"][0].as_py()])
        at_row, pieces, roles, contents = [], [], [], []
        for row, (text, own) in enumerate(zip(table["text"].to_pylist(), states)):
            piece = -1
            for line, state in zip((text or "").split("\n"), own):
                if state < len(ROLES):
                    piece += 1
                    at_row.append(row)
                    pieces.append(piece)
                    roles.append(ROLES[state])
                    contents.append([_said(line, state)])
                else:
                    contents[-1].append(line)
        contents = ["\n".join(c) for c in contents]
        index = pa.array(at_row, pa.int64())
        return pa.table({
            conv_col: table["conv"].take(index), turn_col: table["turn"].take(index),
            "piece": pa.array(pieces, pa.int32()), "role": roles, "text": contents,
            "rendered": [render(r, c) for r, c in zip(roles, contents)]}).cast(arrow)

    used = ordered.select("part", "place", "conv", "turn", "codes", "text")
    return used.groupBy("part").applyInArrow(turns, schema)
