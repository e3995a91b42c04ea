import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewmill.llm import packing, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def filled(places, capacity):
    """Sequences have no gaps and keep to the capacity; how many there are."""
    by_sequence = defaultdict(list)
    for sequence, offset, length in places:
        by_sequence[sequence].append((offset, length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 30, 100, 2048])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 60))}
    numbers, places = Counter(), []
    for s in packing.plan(counts, capacity):
        assert s.first == numbers[s.length]
        for i in range(s.last - s.first):
            places.append((s.sequence + i // s.copies, s.offset + i % s.copies * s.length, s.length))
        numbers[s.length] = s.last
    assert numbers == Counter(counts)
    used = filled(places, capacity)
    total = sum(n * c for n, c in counts.items())
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    assert used >= max(-(-total // capacity), large)
    assert used <= 1.25 * max(-(-total // capacity), large) + 1


def test_large_pieces_pair_by_matching():
    slots = packing.plan({60: 1, 55: 1, 45: 1, 40: 1}, 100)
    assert max(s.sequence for s in slots) == 1


def check(rows, texts, plain, capacity):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, pieces in by_doc.items():
        ids = plain(texts[doc_id])
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces[:-1]]).tolist()
        assert sum(r.length for r in pieces) == len(ids)
        assert all(r.length == capacity for r in pieces[1:]) and len(pieces) == -(-len(ids) // capacity)
        for r in pieces:
            raw = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
    return filled([(r.sequence_id, r.offset, r.length) for r in rows], capacity)


def test_query_equals_the_plain_tokenizer(spark, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_best_fit_packing(spark, SF).collect()
    used = check(rows, texts, plain, 2048)
    assert used <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_odd_texts(spark, plain, tmp_path):
    odd = [None, "", "a", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", " " * 5000, "é\U0001F600\n\n\t don't", "z" * 9000, "12 34 ... !!"]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(odd)],
                                 "doc_id long, text string, length int, chunk string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(queries.op9_best_fit_packing(spark, str(tmp_path)).collect(), dict(enumerate(odd)), plain, 2048)
    assert plain(odd[3])[:3] == [64, 220, 50256]
    twice = packing.pack(docs.unionAll(docs), 16).collect()
    filled([(r.sequence_id, r.offset, r.length) for r in twice], 16)
    ids = defaultdict(list)
    for r in sorted(twice, key=lambda r: r.start):
        assert len(r.ids) == 4 * r.length
        ids[r.doc_id].append((r.start, bytes(r.ids)))
    for i, text in enumerate(odd):
        whole = np.frombuffer(b"".join(p for _, p in sorted(set(ids[i]))), "<u4").tolist()
        assert whole == plain(text)
    assert packing.pack(docs.limit(0)).collect() == []
