"""Words that all titles share, and classes of equal vectors."""

import re

import numpy as np
import pytest

from tidewell.operators import dedup
from tidewell.sources.providers import table_provider


def brute(queries, rows, limit):
    words = lambda t: {w for w in re.split("[^a-z0-9]+", (t or "").lower()) if len(w) >= 3}
    out = set()
    for i, q in queries:
        hits = sorted((-len(words(q) & words(t)), u, t) for u, t in rows if words(q) & words(t))
        out |= {(i, u, t, float(-n)) for n, u, t in hits[:limit]}
    return out


@pytest.mark.parametrize("common", [0, 3, 20, 10_000])
def test_hits_equal_brute_force_whatever_is_common(spark, common):
    rng = np.random.default_rng(2)
    vocabulary = ["the", "and", "for", *[f"word{i}" for i in range(40)]]
    weight = np.array([20, 12, 8, *[1] * 40], float)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=weight / weight.sum()))
    rows = [(f"http://h/{i:04}", text(rng.integers(1, 7))) for i in rng.permutation(250)] + [("http://h/null", None), ("http://h/empty", "")]
    queries = [(i, text(rng.integers(1, 6))) for i in range(40)] + [(90, "the"), (91, "the and for"), (92, "absent"), (93, None)]
    table = spark.createDataFrame(rows, "address string, head string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, query string").repartition(2)
    got = table_provider(table, "address", "head", 3, common=common)(asked).collect()
    assert {tuple(r) for r in got} == brute(queries, rows, 3) and len(got) == len(set(got))


def test_equal_titles_meet_as_one_class(spark):
    rows = spark.range(3000).selectExpr("concat('u', lpad(id, 5, '0')) AS u", "if(id = 2999, 'the rare', 'the same title') AS t")
    asked = spark.createDataFrame([(1, "the same"), (2, "the rare")], "query_id long, query string")
    got = sorted(map(tuple, table_provider(rows, "u", "t", 2)(asked).collect()))
    assert got == [(1, "u00000", "the same title", 2.0), (1, "u00001", "the same title", 2.0), (2, "u00000", "the same title", 1.0), (2, "u02999", "the rare", 2.0)]


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """Six thousand rows of three vectors: a forest of one link a row, and classes with their sizes."""
    monkeypatch.setattr(dedup, "BLOCK", 64)
    rows = spark.range(6000).selectExpr("id", "'g' AS g", "CASE id % 3 WHEN 0 THEN array(1D, 0D) WHEN 1 THEN array(0.9D, 0.1D) ELSE array(0D, -1D) END AS v")
    links = dedup.similar_pairs(rows, "id", "v", 0.8, ["g"], forest=True).collect()
    assert len(links) <= 6000
    made = dedup.components(rows.withColumnRenamed("id", "node"), spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long"))
    assert {r.component: r["count"] for r in made.groupBy("component").count().collect()} == {0: 4000, 2: 2000}
    (pair,) = dedup.similar_classes(rows, "id", "v", 0.8, ["g"]).collect()
    assert (pair.a, pair.b, pair.a_rows, pair.b_rows) == (0, 1, 2000, 2000)
    members = dedup.vector_classes(rows, "id", "v", ["g"])
    assert members.where("head <> key % 3").count() == 0 and members.count() == 6000
