import itertools

import numpy as np
import pytest

from reviewmill.llm import chat, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, piece string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def parsed(spark, rows, parts=3):
    return sorted(chat.parse(frame(spark, rows), parts).collect(), key=lambda r: (r.conv_id or -1, r.turn, r.piece))


def test_query_renders_every_row(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = queries.op8_chat_formatting(spark, SF).collect()
    want = {(r.conv_id, r.turn): f"<|im_start|>{r.role}\n{r.text}<|im_end|>\n" for r in rows}
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): r.rendered for r in got} == want


def test_roles_that_are_missing_are_recovered(spark):
    rows = [(r.conv_id, r.turn, r.role if r.conv_id % 2 else None, r.text)
            for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    truth = {(r.conv_id, r.turn): r.role for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = [r for r in parsed(spark, rows) if r.conv_id % 2 == 0]
    right = np.mean([truth[r.conv_id, r.turn] == r.role for r in got])
    assert right > 0.8


def test_every_other_role_is_recovered(spark):
    truth = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = queries.recovered_roles(spark, SF).collect()
    assert {(r.conv_id, r.turn): r.text for r in got} == {k: r.text for k, r in truth.items()}
    blank = [r for r in got if r.turn % 2 != r.conv_id % 2]
    right = np.mean([truth[r.conv_id, r.turn].role == r.role for r in blank])
    plain = np.mean([truth[r.conv_id, r.turn].role == "user" for r in blank])  # the most frequent role
    assert len(blank) > 200 and right > 0.9 > plain + 0.3
    assert all(truth[r.conv_id, r.turn].role == r.role for r in got if r.turn % 2 == r.conv_id % 2)


def test_a_given_role_wins_over_the_text(spark):
    rows = [(1, 0, "user", "Model: X200 will not start"), (1, 1, "assistant", "Assistant: try again"),
            (1, 2, "user", "A: or B?"), (1, 3, None, "Assistant: B"), (1, 4, "user", "User: thanks\nAssistant: bye")]
    assert [(r.turn, r.role, r.text) for r in parsed(spark, rows)] == [
        (0, "user", "Model: X200 will not start"), (1, "assistant", "try again"), (2, "user", "A: or B?"),
        (3, "assistant", "B"), (4, "user", "thanks"), (4, "assistant", "bye")]


def test_markers_are_learned_from_rows_with_a_role():
    counts = np.zeros((chat.STATES, chat.CODES))
    roles, none = len(chat.ROLES), np.zeros((3, 4))
    odd = none.copy()
    odd[0, 1] = 500  # texts of users that start with the marker of the assistant
    codes = [chat.line_code("AI: hello there", True, chat.NONE)]
    for markers, want in ((none, 1), (odd, 0)):
        m = chat.model(counts, np.zeros(roles), np.zeros((roles, roles)), markers)
        assert chat.decode(m, bytes(codes), None, None)[0] == want


def test_parts_follow_the_size_of_the_texts(spark, monkeypatch):
    rows = [(c, t, None if t == 2 else ("user", "assistant")[t % 2], f"text {c} {t} " + "word " * 30)
            for c in range(30) for t in range(4)]
    want = sorted(map(tuple, chat.parse(frame(spark, rows)).collect()))
    monkeypatch.setattr(chat, "PART_CHARS", 1000)
    seen = []
    ordered = chat._ordered
    monkeypatch.setattr(chat, "_ordered", lambda *a: seen.append(a[-1]) or ordered(*a))
    assert sorted(map(tuple, chat.parse(frame(spark, rows)).collect())) == want and seen[0] >= 18


def test_markers_inside_a_text_begin_turns(spark):
    text = "User: how are you?\nstill me\nAssistant: fine\n### Human: good\n<|assistant|> bye"
    got = parsed(spark, [(1, 0, None, text), (2, 0, "human", "hi"), (2, 1, "AI", "Note: colons\nare text")])
    assert [(r.conv_id, r.piece, r.role, r.text) for r in got] == [
        (1, 0, "user", "how are you?\nstill me"), (1, 1, "assistant", "fine"), (1, 2, "user", "good"),
        (1, 3, "assistant", "bye"), (2, 0, "user", "hi"), (2, 0, "assistant", "Note: colons\nare text")]


def test_parts_do_not_change_the_result(spark):
    """One long conversation lies in many parts; its missing roles are found all the same."""
    rows = [(7, i, ("user", "assistant")[i % 2] if i % 5 else None, f"line {i}\nmore" + "?" * (i % 2 == 0))
            for i in range(300)]
    rows += [(c, t, ("user", "assistant")[t % 2], "a\nb") for c in (1, 2, 9) for t in range(4)]
    one, many = parsed(spark, rows, 1), parsed(spark, rows, 13)
    assert [tuple(r) for r in one] == [tuple(r) for r in many]
    long = [r for r in one if r.conv_id == 7]
    assert [r.role for r in long] == [("user", "assistant")[i % 2] for i in range(300)]


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "tool", ""), (None, 0, None, "x"), (1, None, "user", "y"),
            (1, 0, "user", None), (2, 0, "user", "long " * 40000 + "\n" * 3000)]
    got = chat.parse(frame(spark, rows), 4).collect()
    assert len(got) == 6
    assert sum(r.text == "" for r in got) == 3
    assert {r.text for r in got} >= {"x", "y", rows[-1][3]}
    assert chat.parse(frame(spark, rows).limit(0)).collect() == []


def best_path(m, codes):
    ways = itertools.product(range(chat.STATES), repeat=len(codes))
    return max(m.begin[w[0]] + m.emit[w[0], codes[0]] + sum(
        m.step[a, b] + m.emit[b, c] for a, b, c in zip(w, w[1:], codes[1:])) for w in ways)


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_equals_all_paths(seed):
    rng = np.random.default_rng(seed)
    m = chat.Model(rng.normal(size=(chat.STATES, chat.CODES)), rng.normal(size=chat.STATES),
                   rng.normal(size=(chat.STATES, chat.STATES)))
    codes = bytes(rng.integers(0, chat.CODES, 5).tolist())
    path = chat.decode(m, codes, None, None)
    score = m.begin[path[0]] + m.emit[path[0], codes[0]] + sum(
        m.step[a, b] + m.emit[b, c] for a, b, c in zip(path, path[1:], codes[1:]))
    assert score == pytest.approx(best_path(m, codes))
    assert chat.scores(m, codes, None).max() == pytest.approx(score)
    unit = np.where(np.eye(chat.STATES, dtype=bool), 0.0, -1e9)
    head, tail = chat.scores(m, codes[:2], None), chat.scores(m, codes[2:], unit)
    assert (head[:, None] + tail).max() == pytest.approx(score)
