"""Fill-in-middle: the list of boundaries, seeded cuts against plain Python, exact restoring."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import fillmiddle
from tidewell.llm.fillmiddle import EliasFano, fill_in_middle, restore, text_groups, token_ends

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", "  two  words \n", "tail  \t", "ñ é x 😀😀 ß", "with <P> inside", "<S>", "x<M", "a < b <S c > <", "line\none\x0btwo", "same text of copies", "\x00 nul \x00", "word " * 4000]


@given(st.lists(st.integers(1, 60), min_size=1, max_size=300))
@settings(max_examples=150, deadline=None)
def test_every_number_comes_back(gaps):
    values = np.cumsum(gaps)
    packed = EliasFano(values)
    assert [packed[i] for i in range(len(values))] == values.tolist()
    assert packed.nbytes() <= (len(values) * (2 + max(0, np.log2(values[-1] / len(values))) + 1)) / 8 + 2


@given(st.text(st.sampled_from("ab \n\té😀 \x0b"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_ends_are_those_of_the_rule(text):
    assert token_ends(text).tolist() == [m.end() for m in TOKEN.finditer(text)]


def plainly(i, text, seed, percent, spm):
    """The contract, word by word."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("percent,spm", [(50, 80), (100, 0), (100, 50), (0, 50)])
def test_equals_plain_python(spark, percent, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "same text of copies") for i in range(40)] + [(3, "a"), (3, "a"), (None, "no id at all"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("output", F.lit("clash")).withColumn("form", F.lit(1))
    made = fill_in_middle(docs, 42, percent, spm, carry=["output", "form"]).withColumn("again", restore("output", "form")).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in made), key=repr)
    assert got == sorted(((i, *plainly(i, t, 42, percent, spm), t or "") for i, t in rows), key=repr)
    assert all(r.doc.output == "clash" and r.doc.form == 1 for r in made)


def test_copies_are_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(fillmiddle, "COPIES", 16)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "one text for many").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    keyed = text_groups(docs.select("doc_id", F.col("text").alias("_text"), F.xxhash64("doc_id").alias("_salted")))
    sizes = [r["count"] for r in keyed.groupBy("_key", "_salt").count().collect()]
    assert max(sizes) < 48 and sum(sizes) == 400 and len(sizes) > 110
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_in_middle(docs).collect()}
    assert got == {r.doc_id: plainly(r.doc_id, r.text, 42, 50, 80) for r in docs.collect()}


def test_boundaries_are_found_once_a_group(spark, tmp_path):
    """Each group's text reaches Python with its first document alone."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id") % 3).alias("text"))
    plan = fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "ArrowEvalPython" in plan and "CASE WHEN _first" in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(empty).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fill_in_middle(empty).count() == 0
