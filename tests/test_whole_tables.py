"""Queries without SQL answer for every row of their table."""

import os

import pytest
from pyspark.sql import functions as F

from tidewell.functions.chunking import cut_sliding, split_windows
from tidewell.operators.pluggable import hashed_embedding
from tidewell.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text").collect()


def test_sliding_chunks_of_all_documents(spark, documents):
    got = {(r.doc_id, r.i): r.chunk for r in QUERIES["q137_sliding_chunks"](spark, DATA).collect()}
    assert got == {(d.doc_id, i): c for d in documents for i, c in enumerate(cut_sliding(d.text or ""))}


def test_token_windows_of_all_documents(spark):
    got = {tuple(r) for r in QUERIES["q142_token_windows"](spark, DATA).collect()}
    want = set()
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        lines = [b for b in (d.text or "").split("\n") if b.strip(" ")]
        text = "\n".join(f"[P_{i}] {x}" + (f"\n[FIG_{i // 10}] A drawing." if i % 10 == 0 else "") for i, x in enumerate(lines, 1))
        want |= {(d.doc_id, i, w["first"], w["last"], w["tokens"], w["paragraphs"], w["figures"]) for i, w in enumerate(split_windows(text, f"# {d.source} {d.lang}"))}
    assert got == want and max(r[1] for r in got) > 0


def test_pairs_of_all_documents(spark, documents):
    import numpy as np

    got = {(r.a, r.b) for r in QUERIES["q178_injected_functions"](spark, DATA).where(F.col("a") < F.col("b")).collect()}
    v = hashed_embedding([d.text or "" for d in documents])
    same = v @ v.T
    near = {(min(x.doc_id, y.doc_id), max(x.doc_id, y.doc_id)): same[i, j] for i, x in enumerate(documents) for j, y in enumerate(documents[:i]) if x.lang == y.lang and same[i, j] > 0.9499}
    assert got - set(near) == set() and {p for p, s in near.items() if s > 0.9501} <= got
    assert max(np.ravel(list(got))) >= 150
