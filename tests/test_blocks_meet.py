"""Blocks meet where they lie: what moves doesn't grow with the number of blocks."""

from moved import shuffled
from pyspark.sql import functions as F

from tidewell.operators import retrieval


def test_words_do_not_move_once_for_each_block(spark, monkeypatch):
    """240 lines in 2 blocks and in 12: each query's 300 words went to each block."""
    word = lambda n, step: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sha1((i * step + F.col("id")).cast("string")))
    queries = spark.range(40).select(F.col("id").alias("focus"), word(300, 7).alias("words"))
    lines = spark.range(240).select(F.format_string("line %03d", "id").alias("line"), word(5, 3).alias("words"))
    monkeypatch.setattr(retrieval, "ASKED", 20)
    moved, rows = [], []
    for size in (120, 20):
        monkeypatch.setattr(retrieval, "COUNTED", size)
        before = shuffled(spark)[0]
        found = retrieval.shared_words(queries, lines, "focus", "line", "words", 3).collect()
        moved.append(shuffled(spark)[0] - before)
        ranked = {f: sorted((-r.shared, r.line) for r in found if r.focus == f)[:3] for f in range(40)}
        rows.append(ranked)
    assert rows[0] == rows[1] and all(rows[0].values())
    assert moved[1] < 1.5 * moved[0]


def test_rows_of_many_words_set_a_bar(spark, monkeypatch):
    """Few rows are counted first; what has fewer words than the bar isn't, and ties at the bar are."""
    monkeypatch.setattr(retrieval, "HEAD", 10)
    monkeypatch.setattr(retrieval, "COUNTED", 16)
    words = [f"w{i}" for i in range(40)]
    lines = [(f"line {i:02d}", words[i % 7 : i % 7 + 1 + i % 9]) for i in range(90)]
    asked = [(1, words), (2, words[:3]), (3, []), (4, ["none"]), (5, words[3:12])]
    found = retrieval.shared_words(spark.createDataFrame(asked, "focus long, words array<string>"), spark.createDataFrame(lines, "line string, words array<string>"), "focus", "line", "words", 4).collect()
    for f, k in asked:
        want = sorted((-n, line) for line, w in lines if (n := len(set(w) & set(k))))[:4]
        assert sorted((-r.shared, r.line) for r in found if r.focus == f) == want


def test_trust_rank_sends_the_best_of_each_trust_only(spark, tmp_path, monkeypatch):
    """All pairs went to the ranking; scores that weighing makes equal go by id, copies too."""
    import numpy as np

    from tidewell.functions.scores import passes_trust
    from tidewell.plans.catalog import QUERIES

    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    vectors = [(base + rng.normal(size=8) * rng.choice([0, 1e-3, 2e-3, 0.5])).tolist() for _ in range(1500)]
    table = spark.createDataFrame([(i, v, i % 5) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(retrieval, "CELL", 500)
    met, score_pairs = [], retrieval.score_pairs
    monkeypatch.setattr(retrieval, "score_pairs", lambda *a, **b: (met.append(score_pairs(*a, **b)), met[-1])[1])
    got = sorted(map(tuple, QUERIES["q110_batched_trust_rank"](spark, str(tmp_path)).collect()))
    sent = met[0].count()
    every = score_pairs(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", apart=True)
    t = F.when((F.col("vec_id") % 5 == 0) | (F.col("vec_id") % 7 == 0), 1.0).otherwise((F.col("vec_id") % 7) / 10.0)
    sim = F.col("score") * 0.9
    ranked = {}
    for r in every.where(passes_trust(sim, t)).select("query", "vec_id", F.round(sim * t, 6).alias("s")).collect():
        ranked.setdefault(r.query, []).append((-r.s, r.vec_id))
    assert got == sorted((q, i, -s) for q, rows in ranked.items() for s, i in sorted(rows)[:5])
    assert sent < 15_000  # 30 queries with 1499 rows each are 44,970 pairs


def test_vectors_do_not_move_once_for_each_block(spark, monkeypatch):
    """Pairs of a group in 2 blocks and in 16: each vector went to each block of its group."""
    import numpy as np

    from tidewell.operators import dedup

    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    vectors = np.array([base + rng.normal(size=16) * 0.4 for _ in range(640)])
    table = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(vectors)], "id long, v array<double>, g int").cache()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    same = np.round(unit @ unit.T, 9)
    want = {(i, j) for i in range(640) for j in range(i + 1, 640) if i % 2 == j % 2 and same[i, j] >= 0.95}
    monkeypatch.setattr(dedup, "PIVOTS", 1)
    monkeypatch.setattr(dedup, "MOST_PIVOTS", 1)
    moved = []
    for size in (160, 20):
        monkeypatch.setattr(dedup, "BLOCK", size)
        before = shuffled(spark)[0]
        got = [(r.a, r.b) for r in dedup.similar_pairs(table, "id", "v", 0.95, within=["g"]).collect()]
        moved.append(shuffled(spark)[0] - before)
        assert len(got) == len(set(got)) and set(got) == want
    assert moved[1] < 2 * moved[0]


def test_best_of_bm25_makes_no_pairs(spark, tmp_path):
    """40 queries and 900 documents share a word; each pair of them was exchanged."""
    from tidewell.plans.catalog import QUERIES

    docs = [(i, "common " * (1 + i % 3) + " ".join(f"word{(i * j) % 61:02d}" for j in range(i % 40))) for i in range(900)]
    talks = [(50 * q, 0, "user", f"common word{q:02d} word{q + 7:02d}") for q in range(40)]
    table = spark.createDataFrame([*docs, (7, "common word03")], "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(talks, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    before = shuffled(spark)[1]
    got = sorted(map(tuple, QUERIES["q108_lexical_vector_search"](spark, str(tmp_path)).collect()))
    moved = shuffled(spark)[1] - before
    every = retrieval.bm25(table, spark.createDataFrame([(q, t.split()) for q, _, _, t in talks], "conv_id long, terms array<string>"), "doc_id", F.split("text", " "), "conv_id", F.col("terms"))
    ranked = {}
    for r in every.withColumn("s", F.round("score", 4)).collect():
        ranked.setdefault(r.query, []).append((-r.s, r.doc_id))
    assert got == sorted((q, i, -s) for q, rows in ranked.items() for s, i in sorted(rows)[:5])
    assert moved < 10_000  # 36,000 pairs
