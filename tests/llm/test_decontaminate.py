import hashlib
import re

from tidewell.llm import decontaminate
from tidewell.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"Bench{i}" for i in range(25))
ITEMS = [(1, LONG), (2, "short Item here"), (10, LONG.upper()), (3, None), (4, "..."), (None, LONG), (5, "é É 你 a b c d e f g h i")]
DOCS = [
    (1, None), (2, ""), (3, "clean words only " * 9), (4, "lead " + LONG + " tail"), (5, LONG.replace(" ", "--") * 2), (6, "a short, item; HERE and short item here"),
    (7, " ".join(LONG.split()[:9])), (8, " ".join(LONG.split()[:10])), (8, "é É 你 A b c d e f g h"), (None, LONG), (9, "x " * 3000 + LONG + " y" * 3000), (10, "é É 你"), (11, "é é 你 a b c d e f g h i"),
]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            b = words(text)
            if item is None or not b:
                continue
            n = min(width, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams]
            hit |= {k + j for k in at for j in range(n)}
            ids |= {str(item)} if at else set()
        out.append((i or 0, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, 7, "w") for r in DOCS], "doc_id long, text string, n_words int, window string").repartition(3)
    bench = spark.createDataFrame([(*r, "z") for r in ITEMS], "item_id long, text string, size string")
    for bound in (500_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
        got = contamination(docs, bench).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(DOCS, ITEMS)
    spans = {r.doc_id: [(s["first"], s["last"]) for s in r.spans] for r in got}
    assert spans[4] == [(1, 25)] and spans[6] == [(1, 3), (5, 7)]


def test_filter_grows_with_the_windows(spark, monkeypatch):
    """Every window passes, and few others do, whatever the number of windows."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(decontaminate, "LEAST_CHARS", decontaminate.CHUNK)
    for n in (10, 30_000):
        made = decontaminate.WindowFilter(spark.range(n).select(F.xxhash64("id").alias("h")), n)
        assert made.chars % decontaminate.CHUNK == 0 and 6 * made.chars >= 16 * n
        probe = spark.range(3 * n).select((F.col("id") < n).alias("window"), made.passes(F.xxhash64("id")).alias("passes"))
        got = {(r.window, r.passes): r["count"] for r in probe.groupBy("window", "passes").count().collect()}
        assert got[True, True] == n and got.get((False, True), 0) < max(2, 0.04 * n)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_drops_hit_documents(spark):
    docs = spark.createDataFrame([(*r, 7) for r in DOCS], "doc_id long, text string, _id int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = [(i or 0, t) for i, t in DOCS]
    want = sorted(((i, t or "") for (i, t), b in zip(clean, [brute([d], ITEMS)[0][-1] for d in DOCS]) if not b))
    assert sorted((r.doc_id or 0, r.text or "") for r in drop_contaminated(docs, bench).collect()) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    got = contamination(spark.createDataFrame(DOCS, "doc_id long, text string"), none).collect()
    assert len(got) == len(DOCS) and not any(r.contaminated for r in got)


def test_bounds_by_bytes_and_a_full_filter_change_nothing(spark, monkeypatch):
    """Windows and items shuffled for their bytes, a filter that lets nearly all through, windows of many items."""
    items = [*ITEMS, *[(100 + i, LONG) for i in range(60)]]
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "LEAST_CHARS", 64)
    monkeypatch.setattr(decontaminate, "MOST_CHARS", 64)
    monkeypatch.setattr(decontaminate, "CHUNK", 64)
    for most in (1 << 26, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        got = contamination(docs, bench).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(DOCS, items)
        kept = [(r.doc_id or 0, r.text or "") for r in drop_contaminated(docs, bench).collect()]
        assert sorted(kept) == sorted((i or 0, t or "") for i, t in DOCS if not brute([(i, t)], items)[0][-1])
