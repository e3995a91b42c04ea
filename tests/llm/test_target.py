import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from reviewmill.llm import queries, target

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ODD = [None, "", " ,;", "One TWO 3four", "é_É ß", "x" * 10_000, "a b " * 3000, "same text", "same text"]


def grams(text, longest):
    words = WORD.findall((text or "").encode().lower())
    return words, [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def by_hand(docs, goal, longest=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    def counted(texts):
        out = [0] * buckets
        for t in texts:
            for g in grams(t, longest)[1]:
                out[zlib.crc32(g) % buckets] += 1
        return out
    s, t = counted(x for _, x in docs), counted(goal)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
            for b in range(buckets)]
    rows = []
    for place, (i, text) in enumerate(docs):
        words, found = grams(text, longest)
        weight = sum(gain[zlib.crc32(g) % buckets] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(found), weight,
                     weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[5] = k + 1
    return rows


def key(row):
    return [(x is not None, x) for x in row]


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    goal = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op12_target_resampling(spark, SF).collect()
    assert sorted(map(list, got), key=key) == sorted(by_hand(docs, goal), key=key)
    assert {t for _, t in queries.op12_target_resampling(spark, SF).drop("doc_id").dtypes} == {"bigint"}


def test_checksums_of_spans_of_any_length(monkeypatch):
    rng = random.Random(5)
    data = bytes(rng.randrange(256) for _ in range(20_000))
    spans = [(a, a + n) for n in [*range(1, 300), 4096, 4097, 9999] for a in (rng.randrange(20_000 - n),)]
    spans.append((0, 20_000))
    starts, ends = np.array(spans).T
    want = [zlib.crc32(data[a:b]) for a, b in spans]
    assert target.crc32(np.frombuffer(data, np.uint8), starts, ends).tolist() == want
    monkeypatch.setattr(target, "_BLOCKS", 10)
    assert target.crc32(np.frombuffer(data, np.uint8), starts, ends).tolist() == want


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_odd_texts_repeats_and_word_runs(spark, longest):
    rng = random.Random(9)
    rows = [(i % 7 if i % 7 else None, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choices("aa bb cc é 12".split(), k=rng.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, _place string, rank int")
    goal = spark.createDataFrame([("aa bb aa",), (None,)], "text string")
    got = target.resample(docs, goal, longest, buckets=97, percent=50)
    assert sorted(map(list, got.collect()), key=key) == sorted(
        by_hand(rows, ["aa bb aa", None], longest, 97, 50), key=key)
    assert target.resample(docs.limit(0), goal).count() == 0


def test_ties_go_to_the_smaller_id_and_repeats_in_order(spark):
    docs = spark.createDataFrame([(2, "w " * 20)] * 10, "doc_id long, text string")
    got = target.resample(docs, docs.limit(0), percent=30).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3]
