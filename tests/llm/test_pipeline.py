from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from reviewmill.llm import decontaminate, resample, secrets, simhash
from reviewmill.llm.common import staged

SF = "/root/testdata/sf0.01"


def test_stages_do_what_their_operators_say(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs, after = source, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = after[name] = staged(stage(spark, docs, SF), name)
        if name != "best_fit_packing":
            assert docs.dtypes == source.dtypes

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    kept = resample.resample(source, labels).where("_kept")
    assert ids(after["quality_classifier"]) == ids(kept)
    groups = simhash.near_duplicates(after["quality_classifier"])
    assert ids(after["simhash_near_dedup"]) == ids(groups.where("doc_id = component_id"))
    leaks = {r.doc_id for r in decontaminate.leaks(after["simhash_near_dedup"], bench).collect()}
    assert leaks and ids(after["benchmark_decontamination"]) == sorted(
        set(ids(after["simhash_near_dedup"])) - leaks)
    clean = after["secret_scans"]
    assert ids(clean) == ids(after["benchmark_decontamination"])
    assert secrets.scan(clean).where("size(spans) > 0").count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0

    texts = {r.doc_id: r.text for r in clean.collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = defaultdict(list)
    for r in docs.collect():
        found[r.doc_id].append((r.start, bytes(r.ids)))
    assert found.keys() == texts.keys()
    for doc_id, pieces in found.items():
        *ids_of, end = np.frombuffer(b"".join(p for _, p in sorted(pieces)), "<u4").tolist()
        assert end == 0 and tokenizer.decode(ids_of) == texts[doc_id]


def test_empty_and_odd_documents(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "", None, None, None),
            (2, "token=abcdefgh and more", "en", "s", 23), (3, "word " * 5000, "en", "s", 25000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for number, own in enumerate((rows, [])):
        docs = spark.createDataFrame(own, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, str(tmp_path)), f"odd-{number}")
        assert docs.count() >= len(own[:1])
