"""Small literal cases of the rules."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scores, texts, urls
from tidewell.functions.chunking import annotated_blocks, cut_sliding, split_windows
from tidewell.functions.html import paragraphs_of
from tidewell.functions.vectors import cosine, mean_vector
from tidewell.operators import dedup, graphs, greedy, learning, matching, queueing
from tidewell.operators import ranking as rank
from tidewell.operators import tables as ops
from tidewell.operators.packing import next_fit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("relevance", "kept"), [([0.82, 0.80, 0.79, 0.52], 3), ([0.82, 0.81, 0.80, 0.79], 4), ([0.0, 0.0], 0), ([0.29], 0), ([0.30], 1)])
def test_knee(spark, relevance, kept):
    pool = spark.createDataFrame([(0, i, r) for i, r in enumerate(relevance)], "q int, id int, s double")
    assert rank.knee_cutoff(pool, ["q"], "s", "id").count() == kept


def test_reorder(spark):
    pool = spark.createDataFrame([(0, i, 1.0 - i / 10) for i in range(5)], "q int, id int, s double")
    assert [r.id for r in rank.positional_reorder(pool, ["q"], "s", "id").orderBy("place").collect()] == [0, 2, 3, 4, 1]


def test_semantic_dedup_keeps_the_first(spark):
    pool = spark.createDataFrame([(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.85, [0.99, 0.01])], "q int, id int, s double, v array<double>")
    assert [r.id for r in greedy.distinct_vectors(pool, ["q"], "id", "v", "s", 0.85).collect()] == [1]


def test_a_dropped_row_suppresses_nothing(spark):
    pool = spark.createDataFrame([(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.8, [0.8, 0.6]), (0, 3, 0.7, [0.28, 0.96])], "q int, id int, s double, v array<double>")
    assert [r.id for r in greedy.distinct_vectors(pool, ["q"], "id", "v", "s", 0.75).orderBy("place").collect()] == [1, 3]


def test_mmr_and_caps(spark):
    pool = spark.createDataFrame([(0, i, s, v, src) for i, (s, v, src) in enumerate([(0.9, [1.0, 0.0], "a"), (0.89, [1.0, 0.0], "a"), (0.5, [0.0, 1.0], "b")])], "q int, id int, s double, v array<double>, src string")
    assert [r.id for r in greedy.mmr(pool, ["q"], "id", "v", "s", 2, 0.62).orderBy("place").collect()] == [0, 2]
    assert [r.id for r in greedy.mmr(pool, ["q"], "id", "v", "s", 2, 1.0).orderBy("place").collect()] == [0, 1]
    assert [r.id for r in greedy.mmr_per_source(pool, ["q"], "id", "v", "s", "src", 3, 1).orderBy("place").collect()] == [0, 2]


def test_zero_vectors(spark):
    v = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, cosine(v, F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert value(spark, mean_vector(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0))))) == [2.0, 4.0]


@pytest.mark.parametrize(("sim", "trust", "ok"), [(0.70, 0.15, False), (0.90, 0.15, True), (0.50, 0.85, True), (0.50, None, True)])
def test_trust_cutoff(spark, sim, trust, ok):
    assert value(spark, scores.passes_trust(F.lit(sim), F.lit(trust).cast("double"))) is ok


def test_rerank_signals(spark):
    assert [round(value(spark, scores.citation_share(F.lit(c))), 6) for c in (0, 40, 400)] == [0.0, 1.0, 1.0]
    assert value(spark, scores.recency(F.lit(None).cast("int"), 2025)) == 0.5
    assert value(spark, scores.venue_trust(F.lit(0), F.lit(False), F.lit(False))) == 0.15


def test_pedagogy(spark):
    assert round(value(spark, 0.85 * scores.pedagogy_weight(F.lit("MECHANIC"), F.lit("deep_dive"))), 6) == round(0.85 * 1.35, 6)
    assert value(spark, scores.novelty_weight(F.lit(True), F.lit(True))) == pytest.approx(0.5)


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://arxiv.org/abs/2512.08290", "https://arxiv.org/pdf/2512.08290.pdf"), ("https://doi.org/10.48550/arXiv.2203.08975v2", "https://arxiv.org/pdf/2203.08975v2.pdf"), ("https://doi.org/10.48550/arxiv.hep-th/9901001", "https://arxiv.org/pdf/hep-th/9901001.pdf"), ("https://doi.org/10.5281/zenodo.1234567", "https://zenodo.org/record/1234567")],
)
def test_canonical(spark, url, want):
    assert value(spark, F.coalesce(urls.canonical(F.lit(url)), urls.pdf_address(F.lit(url)))) == want


def test_source_keys(spark):
    key = lambda u: value(spark, urls.source_key(F.lit(u)))
    assert key("https://arxiv.org/abs/2512.08290") == key("https://arxiv.org/pdf/2512.08290.pdf") == "arxiv:2512.08290"
    assert key("https://x.org/A/b?q=1") == key("http://y.org/a/b/") == "doi:a/b"


def test_urls(spark):
    assert value(spark, urls.host(F.lit("HTTPS://user@WWW.Example.org:80/x"))) == "example.org"
    assert value(spark, urls.document_id(F.lit(" "))) == "local"
    assert [value(spark, urls.is_collectible(F.lit(u))) for u in ("http://a.b/c", "http://a.b/", "http://a.b/?q=1", "ftp://a.b/c", "http://youtube.com/c", "http://host/c")] == [True, False, True, False, False, False]
    assert value(spark, urls.practical_reject(F.lit("https://x.org/api/v"))) == "practical_api_doc_path:/api/"


def test_row_id_is_a_version_5_uuid(spark):
    import uuid

    assert value(spark, ops.row_id(F.lit("d"), F.lit(1), F.lit("é x"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "d:1:é x"))


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = ops.upsert(base, new, "id")
    assert sorted(map(tuple, ops.upsert(once, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_archive_keeps_known_values(spark):
    log = spark.createDataFrame([("u", 1, 1, "seen", 0.5), ("u", 2, 2, "rejected", None)], "url string, at int, n int, status string, trust double")
    assert ops.archive(log, "url", "at", ["status"], ["trust"], "n").first().asDict() == {"url": "u", "status": "rejected", "trust": 0.5, "first_seen": 1, "last_seen": 2}


def test_sliding_chunks():
    pieces = cut_sliding("a" * 1500)
    assert len(pieces) >= 2 and all(48 <= len(p) <= 600 for p in pieces)
    prose = " ".join(f"word{i}" for i in range(400))
    known = set(prose.split())
    assert all(w in known for p in cut_sliding(prose) for w in p.split())
    assert cut_sliding("") == [] and cut_sliding("short") == []


def test_windows():
    text = "lead\n" + "\n".join(f"[P_{i}] " + "x" * (370 - len(f"[P_{i}] ")) for i in range(1, 5))
    assert len(annotated_blocks(text)) == 4 and annotated_blocks(" no tags ") == ["no tags"] and annotated_blocks(" ") == []
    spans = lambda *a, **k: [(w["first"], w["last"]) for w in split_windows(text, *a, **k)]
    assert spans(most=250, overlap=100, overhead=0) == [(0, 1), (1, 2), (2, 3)]
    assert spans(most=350, overlap=150, overhead=0) == [(0, 2), (1, 3)]
    assert spans(most=250, overlap=150, overhead=0) == [(0, 1), (2, 3)]  # the overlap would be the whole window
    assert spans(most=250, overlap=0, overhead=60) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert spans(most=50, overlap=0, overhead=0) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert spans("h" * 180, most=250, overlap=0, overhead=0) == [(0, 1), (2, 3)] and spans("h" * 222, most=250, overlap=0, overhead=0) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    w = split_windows("[P_1] a\n[FIG_2] b\n[P_3] c [fig_2] Привет", "T")[0]
    assert (w["paragraphs"], w["figures"]) == ("P_1,P_3", "FIG_2") and w["body"].startswith("T\n\nAvailable figures in document: FIG_2\n\n[P_1] a")
    assert w["tokens"] == int(6 / 1.75 + (len(w["body"]) - 6) / 3.7) + 192


def test_html():
    assert paragraphs_of("<nav>x</nav><p>A&amp;B <b>c</b><p>d<script>e</script>") == ["A&B c", "d"]


def test_text_rules(spark):
    assert value(spark, texts.merge_hyphens(F.lit("algo-\nrithm trans- form Non- Linear"))) == "algorithm transform Non- Linear"
    assert [value(spark, texts.is_noise(F.lit(t))) for t in ("12", "IEEE 2021", "A real sentence about things.", "3.5 %")] == [True, True, False, True]
    assert value(spark, texts.estimated_tokens(F.lit("Привет abc"))) == int(6 / 1.75 + 4 / 3.7)
    assert value(spark, texts.is_challenge(F.lit("Just a Moment..."))) is True


@pytest.mark.parametrize(
    ("tag", "scope"),
    [("[SCOPE: mechanic] x", "MECHANIC"), ("[SCOPE: edge case] x", "PRACTICE"), ("edge-case", "EDGE_CASE"), ("EXAMPLES", "PRACTICE"), ("MECH", "MECHANIC"), ("ERRORS", "ANTI_PATTERN"), ("EDGE_CASES", "PRACTICE"), ("CORNER CASES", "PRACTICE"), ("[scope: METRIC]", "PRACTICE"), ("Principle", "CONCEPT"), ("nothing of it", "CONCEPT"), ("", "CONCEPT"), (None, "CONCEPT")],
)
def test_scope_tags(spark, tag, scope):
    assert value(spark, texts.scope_of(F.lit(tag).cast("string"))) == scope


@pytest.mark.parametrize(
    ("snippet", "is_code"),
    [("Deep Dive: import x", False), ("```\nabc\n```", True), ("x=1", False), ("return 1", True), ("a title of prose", False), ("for (i)", True), ("one\n    two", True), ("a b\nc; d", True), ("f(a)=g(b)", True), ("a -> b, c => d", True), (None, False)],
)
def test_code_snippets(spark, snippet, is_code):
    from tidewell.functions.code import is_likely_code

    assert value(spark, is_likely_code(F.lit(snippet).cast("string"))) is is_code


@pytest.mark.parametrize(
    ("url", "gone"),
    [("https://example.com/a", True), ("https://www.example.com/a", False), ("http://x", False), ("http:/", True), ("ftp://a.org/long", True), ("https://u@LOCALHOST:80/x", True), ("https://a.test", True), ("https://a.testing.org", False), (None, True)],
)
def test_placeholder_addresses(spark, url, gone):
    assert value(spark, urls.is_placeholder(F.lit(url).cast("string"))) is gone


def test_trust_of_zero_in_search(spark):
    assert [value(spark, scores.search_trust(F.lit(x).cast("double"))) for x in (0.0, None, 0.15, -1.0, 2.0)] == [1.0, 1.0, 0.15, 1.0, 1.0]


def test_requeue_at_startup(spark):
    jobs = spark.createDataFrame([(1, "running", "e"), (2, "failed", "e"), (3, None, None)], "job int, status string, error string")
    got = queueing.requeue(jobs, "status", "error", "running", "pending")
    assert sorted(map(tuple, got.collect())) == [(1, "pending", None, True), (2, "failed", "e", False), (3, None, None, False)]


def test_links_off_the_list_are_bold(spark):
    rows = spark.createDataFrame([(1, "[a](x) and [b](y), [c] (d) [e](x)"), (2, "no link"), (3, None)], "i int, t string")
    got = ops.bold_links(rows, "i", "t", spark.createDataFrame([("x",), (None,)], "u string"), "u")
    assert sorted((r.i, r.t) for r in got.collect()) == [(1, "[a](x) and **b**, [c] (d) [e](x)"), (2, "no link")]


def test_token_window_is_half_open(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(0, i, at + dt.timedelta(seconds=s)) for i, s in enumerate((0, 59, 60))], "k int, id int, ts timestamp")
    got = learning.rolling(e, ["k"], "ts", 60, {"n": F.lit(1)})
    assert [r.n for r in got.orderBy("id").collect()] == [1, 2, 2]


def test_peak_counts_ends_first(spark):
    s = spark.createDataFrame([(0, 1, 3), (0, 3, 5), (0, 2, 4)], "k int, a int, b int")
    assert learning.peak_concurrency(s, ["k"], "a", "b").first().peak == 2


def test_moving_factor(spark):
    e = spark.createDataFrame([(0, 2, 1.0), (0, 1, 0.0)], "k int, at int, x double")
    assert queueing.moving_factor(e, ["k"], "at", "x", 1.0, 0.5).first().factor == 0.75


def test_quota_order_flips_when_academic_is_short(spark):
    rows = [(0, 1, "academic", 0.1), (0, 2, "practical", 0.9), (0, 3, "practical", 0.8), (0, 4, "practical", 0.7)]
    got = rank.quota_select(spark.createDataFrame(rows, "q int, id int, b string, s double"), ["q"], "b", "s", "id", 2, 1, 3)
    assert [r.id for r in got.orderBy("place").collect()] == [1, 2, 3]


def test_round_robin(spark):
    rows = [(0, i, h) for i, h in enumerate(["a", "a", "a", "b", "c"])]
    got = rank.round_robin(spark.createDataFrame(rows, "q int, id int, h string"), ["q"], "h", "id", 4, 2)
    assert [r.id for r in got.orderBy("place").collect()] == [0, 3, 4, 1]


def test_interleave_skips_taken_rows(spark):
    rows = [(0, 0, 1, "x"), (0, 0, 2, "y"), (0, 1, 1, "x"), (0, 1, 2, "z")]
    got = greedy.interleave(spark.createDataFrame(rows, "q int, p int, at int, k string"), ["q"], "p", "at", "k", 4)
    assert [r.k for r in got.orderBy("place").collect()] == ["x", "z", "y"]


def test_budget_passes_over_large_rows(spark):
    rows = [(0, i, c) for i, c in enumerate([500.0, 10.0, 900.0, 20.0])]
    got = greedy.within_budget(spark.createDataFrame(rows, "q int, at int, c double"), ["q"], "at", "c", 530, 9)
    assert [r.at for r in got.orderBy("place").collect()] == [0, 1, 3]


def test_next_fit(spark):
    rows = [(0, i, c) for i, c in enumerate([3, 3, 9, 1])]
    got = next_fit(spark.createDataFrame(rows, "q int, at long, c long"), ["q"], "at", "c", 5)
    assert [r.bin for r in got.orderBy("at").collect()] == [0, 1, 2, 3]


def test_repeats(spark):
    rows = [(0, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("user", "a"), ("assistant", "a"), ("user", "a"), ("user", ""), ("user", "")])]
    got = rank.collapse_repeats(spark.createDataFrame(rows, "q int, at int, role string, t string"), ["q"], "at", [F.col("t")], (F.col("role") == "user") & (F.col("t") != ""))
    assert sorted(r.at for r in got.collect()) == [1, 2, 3, 4, 5]


def test_components_of_a_chain(spark):
    nodes = spark.range(40).withColumnRenamed("id", "node")
    links = spark.range(38).selectExpr("id AS a", "id + 1 AS b")
    got = {r.node: r.component for r in dedup.components(nodes, links).collect()}
    assert got[38] == 0 and got[39] == 39


def test_graph_checks(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    e = spark.createDataFrame([(2, 1), (3, 1), (4, 4), (3, 9)], "child long, parent long")
    got = graphs.topology(nodes, e).first()
    assert (got.orphans, got.dangling, got.self_loops, got.components) == (1, 1, 1, 3)
    cyclic = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child long, parent long")
    assert sorted(r.node for r in graphs.on_cycles(cyclic).collect()) == [1, 2, 3]
    each = cyclic.withColumn("g", F.lit(7))
    assert sorted((r.child, r.parent) for r in graphs.break_cycles(each, ["g"]).collect()) == [(2, 3), (3, 1), (4, 1)]
    assert sorted((r.child, r.parent) for r in graphs.break_cycles(each, ["g"], prefer=F.col("node") == 3).collect()) == [(1, 2), (3, 1), (4, 1)]


def test_nearest_limits_before_the_exchange(spark):
    from tidewell.operators.retrieval import nearest

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, embedding array<double>")
    got = nearest(rows.where("id < 2"), rows, "id", "id", 3)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 6


def test_containment(spark):
    a = spark.createDataFrame([(1, "abcdefghij"), (2, "xy"), (3, "nothing here")], "i int, a string")
    b = spark.createDataFrame([(1, "__abcdefghij__"), (2, "cdefghij"), (3, "wxyz"), (4, "y")], "j int, b string")
    assert sorted((r.i, r.j) for r in matching.containment(a, b, "a", "b").collect()) == [(1, 1), (1, 2), (2, 3), (2, 4)]


def test_hamming_pairs(spark):
    rows = spark.createDataFrame([(0, 0b0), (1, 0b111), (2, 0xFF00)], "id long, h long")
    assert [(r.a, r.b, r.distance) for r in dedup.hamming_pairs(rows, "id", "h", 16, 3).collect()] == [(0, 1, 3)]


def test_vector_table(spark, tmp_path):
    from tidewell.sources.vector_table import VectorTable

    t = VectorTable(spark, str(tmp_path / "t"))
    assert t.create() and not t.create()
    rows = spark.createDataFrame([("a", [1.0, 0.0], {"k": "1"}, "m"), ("b", [0.0, 1.0], {"k": "2"}, "m"), ("c", [1.0, 0.0], None, "n")], "id string, embedding array<float>, payload map<string,string>, embed_model string")
    t.upsert(rows)
    t.upsert(rows)
    assert t.rows().count() == 3
    assert [r.id for r in t.search([1.0, 0.1], "m", 2).collect()] == ["a", "b"]
    assert [r.id for r in t.search([1.0, 0.1], "m", 2, F.col("payload")["k"] == "2").collect()] == ["b"]
    t.delete(F.col("id") == "a")
    assert sorted(r.id for r in t.rows().collect()) == ["b", "c"]


def test_streams(spark, tmp_path):
    from tidewell.streaming.rates import distinct_submissions, job_states
    from tidewell.streaming.run import drain, stream_folder

    rows = spark.createDataFrame([(1, "pending", "2024-01-01 00:00:00"), (1, "running", "2024-01-01 00:00:01"), (1, "pending", "2023-01-01 00:00:00"), (2, "completed", "2024-01-01 00:00:00")], "job long, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    s = stream_folder(spark, str(tmp_path / "s"), rows)
    got = drain(job_states(s, "job", "status", "ts", stale=None))
    assert sorted((r.job, r.status, r.step) for r in got.collect()) == [(1, "pending", 1), (1, "running", 2)]
    assert drain(distinct_submissions(s, "ts", ["job"])).count() == 2
