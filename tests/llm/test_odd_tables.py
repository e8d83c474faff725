"""Very long texts, unbroken words, null ids, repeated rows and clashing columns, through every operator."""

import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm.queries import vocabulary

LONG = " ".join(f"word{k % 5000} and" for k in range(480_000))  # 5 MB
WORD = "x" * 1_000_000
ODD = "سلام दुनिया 😀 plain words สวัสดี end line ﬁn"
ROWS = [(1, None), (2, ""), (3, LONG), (4, WORD), (5, ODD), (5, ODD), (None, ODD), (None, None), (6, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["n", "token", "n_words", "kept", "score", "size", "shard", "high", "low", "piece", "length", "block", "payload", "ids"]
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).select("*", *[F.lit("c").alias(c) for c in clash])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(vocabulary(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def by_id(rows, *columns):
    return sorted((r.doc_id or 0, *(r[c] for c in columns)) for r in rows)


def test_packing(docs, library):
    from tidewell.llm.packing import pack_documents

    got = pack_documents(docs, vocabulary("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = {}
    for i, t in ROWS:
        want[i] = want.get(i, 0) + len(ids(library["word_bpe_49k.json"], t)) + 1
    assert {r.doc_id: r.n for r in got} == want


def test_counting(docs, library):
    from tidewell.llm.counting import count_tokens

    got = count_tokens(docs, vocabulary("byte_bpe_50k.json"), head_entries=10).collect()
    assert by_id(got, "n_bytes", "n_tokens") == sorted((i or 0, len((t or "").encode()), len(ids(library["byte_bpe_50k.json"], t))) for i, t in ROWS)


def test_id_files(docs, library):
    from tidewell.llm.idfiles import round_trip

    got = round_trip(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert by_id(got, "n_tokens") == sorted((i or 0, len(ids(library["byte_bpe_50k.json"], t)) + 1) for i, t in ROWS)


def test_scoring(docs):
    from tidewell.llm.ngram import score_documents

    got = score_documents(docs).collect()
    assert len(got) == len(ROWS) and all(r.score < 0 for r in got)


def test_sharding(docs):
    from tidewell.llm.sharding import shard_documents

    got = shard_documents(docs, 4, carry=("n", "size")).collect()
    assert by_id(got, "size", "text_crc32") == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert all(r.doc.n == "c" for r in got)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_quality(docs):
    from tidewell.llm.quality import judge, keep_documents

    got = judge(docs).collect()
    assert len(got) == len(ROWS) and not any(r.kept for r in got)  # LONG repeats its windows
    assert keep_documents(docs).columns == docs.columns and keep_documents(docs).count() == 0


def test_decontamination(docs, spark):
    from tidewell.llm.decontaminate import contamination

    items = spark.createDataFrame([(7, "and word17 and word18"), (8, WORD), (None, "plain words")], "item_id long, text string")
    assert by_id(contamination(docs, items).collect(), "n_items") == [(0, 0), (0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 0), (5, 0), (6, 1)]


def test_toxicity(docs, spark):
    from tidewell.llm.toxicity import drop_toxic, learn, toxic_scores

    labels = spark.createDataFrame([(3, 0), (4, 1), (5, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    got = toxic_scores(docs, learn(docs, labels, F.lit(False))).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    fives = [r.score for r in got if r.doc_id == 5]
    assert fives[0] == fives[1]
    assert drop_toxic(docs, labels).columns == docs.columns


def test_near_copies(docs):
    from tidewell.llm.jaccard import documents_of, keep_one_per_group, link_components

    got = {(r.doc_id, r.component_id) for r in link_components(documents_of(docs)).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 3), (None, 5), (None, None)}
    assert by_id(keep_one_per_group(docs).collect()) == [(0,), (0,), (1,), (2,), (3,), (4,), (5,), (5,)]


def test_resampling(docs, spark):
    from tidewell.llm.resampling import resample

    got = resample(docs, spark.createDataFrame([(3, 1), (5, 1), (4, 0)], "doc_id long, quality int"), k=4).collect()
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == 4
