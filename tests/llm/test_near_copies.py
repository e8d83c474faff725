"""The pipeline's stage of near copies against brute force over five-word shingles."""

import os
import random
import re

import pytest

from tidewell.llm import stages

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Ids that stay: the smallest of each group linked at similarity 0.8."""
    up, sets = {i: i for i, _ in rows}, [(i, shingle_set(t)) for i, t in rows]

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and (same := len(a & b)) and 100 * same >= 80 * (len(a) + len(b) - same):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return sorted(i for i in up if top(i) == i)


def kept(spark, docs):
    return sorted(r.doc_id for r in stages.ngram_jaccard_join(spark, docs, "").collect())


def test_copies_between_the_thresholds_go(spark):
    rng = random.Random(8)
    rows = [(900, None), (901, ""), (902, "one two three"), (903, "ONE two  three"), (904, "one two three four")]
    for g in range(20):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(30, 150))]
        for k in range(5):
            mine = list(words)
            for _ in range(rng.randrange(0, 5)):
                mine[rng.randrange(len(mine))] = f"e{rng.randrange(10**6)}"
            rows.append((10 * g + k, " ".join(mine)))
    assert kept(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stage_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert kept(spark, docs) == brute([tuple(r) for r in docs.collect()])
