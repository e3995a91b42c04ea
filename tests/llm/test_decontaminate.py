import random
import subprocess
import sys
from pathlib import Path

import pytest

from reviewmill.llm import decontaminate as d
from reviewmill.llm import queries

SF = "/root/testdata/sf0.001"


def least_edits(item, text):
    """Edit distance of the item to its closest part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def by_hand(docs, items):
    out = set()
    for doc_id, text in docs:
        words = d.words_of(text)
        for item_id, item in items:
            own = d.words_of(item)
            if own and (n := least_edits(own, words)) <= d.edit_budget(len(own)):
                out.add((doc_id, item_id, n))
    return out


def test_random_edits_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 5, 11, 30])))) for i in range(12)]
    items += [(50, ""), (51, None), (52, items[3][1]), (None, "W1, w2! w3")]
    docs = [(0, None), (1, ""), (2, "w1 w2 w3"), (3, "w1"), (3, "w1")]
    for i in range(60):
        text = rng.choices(words, k=rng.randint(0, 40))
        own = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 4)):
            if own:
                at = rng.randrange(len(own))
                own[at:at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 1))
        docs.append((10 + i, " ".join(text + own + text[:5])))
    frame = spark.createDataFrame([(a, b, 9) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(a, b, "k") for a, b in items], "item_id long, text string, edits string")
    want = by_hand(docs, items)
    for block in (32_000_000, 200):
        rows = d.leaks(frame, bench, block_chars=block).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in rows} == want
    texts = dict(items), {i: d.words_of(t) for i, t in docs}
    for r in rows:  # the place holds the item with so many edits
        part = texts[1][r.doc_id][r.start_word:r.end_word]
        own = d.words_of(texts[0][r.item_id])
        assert least_edits(own, part) == r.edits and r.words == len(own)
    kept = d.without_leaks(frame, bench)
    assert kept.columns == frame.columns
    dirty = {i for i, *_ in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in dirty)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
            if len(r.text) < 4000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12]
    ids, names = {i for i, _ in docs}, {i for i, _ in items}
    got = queries.op3_benchmark_decontamination(spark, SF).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got if r.doc_id in ids and r.item_id in names} == by_hand(
        docs, items)
    whole = {(r.doc_id, r.item_id) for r in got}
    bench = {r.item_id: " ".join(d.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        joined = f" {' '.join(d.words_of(r.text))} "
        assert {i for i, t in bench.items() if f" {t} " in joined} <= {i for a, i in whole if a == r.doc_id}


@pytest.mark.parametrize("size", [1, 3, 70])
def test_pattern_finds_the_closest_place(size):
    rng = random.Random(size)
    for _ in range(60):
        item, text = rng.choices("abcd", k=size), rng.choices("abcd", k=rng.randint(1, 90))
        want = least_edits(item, text)
        got = d.Pattern(item).best(text, size - 1)
        assert (got is None) == (want >= size)
        if got:
            assert got[0] == want == least_edits(item, text[got[1]:got[2]])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(docs, bench).collect() == []
    assert d.without_leaks(docs, bench).count() == 1
    assert d.leaks(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_blocks_of_items_give_the_same_documents(spark):
    rng = random.Random(8)
    items = [" ".join(rng.choices([f"v{i}" for i in range(90)], k=10)) for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"before {items[i % 40]} behind" if i % 3 else f"clean {i}", "x") for i in range(90)]
    rows += [(5, None, "y"), (5, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
    kept = [sorted((r.doc_id, r._row) for r in d.without_leaks(docs, bench, block_chars=n).collect())
            for n in (10**6, 200)]
    assert kept[0] == kept[1] == sorted([(i, "x") for i in range(0, 90, 3)] + [(5, "y")] * 2)
    one, many = (sorted(map(tuple, d.leaks(docs, bench, block_chars=n).collect())) for n in (10**6, 200))
    assert one == many and {r[0] for r in one} == {i for i in range(90) if i % 3}
    assert d.without_leaks(docs, bench.limit(0)).count() == 92


def test_fifty_thousand_items_take_bounded_memory():
    """The automata of all blocks, one after the other as in a worker, in a process of their own."""
    code = """
import random, resource
from reviewmill.llm import decontaminate as d
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(5000)]
items = [(i, rng.choices(words, k=15)) for i in range(50_000)]
size = lambda part: sum(len(w) + 1 for _, ws in part for w in ws)
count = -(-size(items) // d.BLOCK_CHARS)
class Held:
    value = None
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = 0
for block in range(count):
    Held.value = items[block::count]
    assert size(Held.value) < 1.1 * d.BLOCK_CHARS
    matcher = d._matcher(str(block), Held, 0.2)
    assert d._matcher(str(block), Held, 0.2) is matcher
    found += sum(len(matcher.leaks("x " + " ".join(ws) + " y")) for _, ws in Held.value[:50])
assert count > 1 and found >= 50 * count
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, check=True, capture_output=True, text=True, timeout=300)
    assert int(out.stdout) < 1000
