import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        n = out.count()
        assert 0 < n <= seen, name
        docs, seen = out, n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_run_equals_its_stages_by_brute_force(spark):
    """Quality, duplicates and benchmark windows against plain Python on what each stage was given."""
    import re

    from tidewell.llm.quality import RULES, Text

    given = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept = {i for i, t in given.items() if not (x := Text((t or "").encode())).base_failed() and not any(r.rejects(x) for r in RULES)}
    docs = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert {r.doc_id for r in docs.collect()} == kept
    clean = {r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, docs, DATA).collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    assert clean == {i for i in kept if not any(tuple(w[k : k + n]) in windows for w in [words(given[i])] for n in sizes for k in range(len(w) - n + 1))}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} <= clean
