"""The pipeline against its stages in plain Python, stage by stage on what the one before kept."""

import hashlib
import re

import corpus_pipeline
from flowbin.llm import fertility
from llm_brute import brute_classes, brute_leaks, brute_repeats

SF001 = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_by_brute_force(spark):
    documents = spark.read.parquet(f"{SF001}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF001).collect()}
    kept = {r.doc_id for r in fertility.judge(documents).where("fertility.kept").collect()}
    docs = [(r.doc_id, r.text) for r in documents.collect() if r.doc_id in kept]
    classes = brute_classes(docs)
    docs = [(i, t) for i, t in docs if classes[i] == i]
    repeats = {i: (n, gone, digest) for i, n, gone, digest in brute_repeats(docs)}
    docs = [(i, t) for i, t in docs if repeats[i][1] == 0 or repeats[i][1] < repeats[i][0]]
    # texts with cuts are checked by the digest of their words
    same = lambda t: hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t)).encode()).hexdigest()
    for i, t in docs:
        if i in out:
            assert same(out[i].text) == repeats[i][2] and (repeats[i][1] or out[i].text == t)
            assert out[i].n_chars == len(out[i].text) and out[i].round_trip and out[i].n_pieces == len(out[i].ids)
    whole = {i: t for i, t in docs}
    stage = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    from flowbin.llm import substrings

    cut = [(r.doc_id, r.text) for r in substrings.remove_repeats(stage).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i, _, hit, _ in brute_leaks(cut, items) if hit == 0}
    assert set(out) == clean and set(out) <= set(whole)


def test_stages_keep_the_columns_and_stand_odd_input(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, None)]
    long = " ".join(f"word{i % 3000} and" for i in range(15000))
    rows += [(3, long, "en", "s", len(long)), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, SF001)
            n = got.count()
            assert n <= len(rows)
            if name != "piece_encoding":
                assert got.columns == corpus_pipeline.COLUMNS
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF001).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 1, 2, 3]
    left = {r.doc_id for r in corpus_pipeline.substring_dedup(spark, docs, SF001).collect()}
    assert left == {None, 1, 2, 3}
