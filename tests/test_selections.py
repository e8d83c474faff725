"""Queries without SQL against plain versions of their rules, over whole tables."""

import os
from difflib import SequenceMatcher
from urllib.parse import urlparse

import duckdb
import numpy as np
import pytest

from tidewell.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return con


@pytest.fixture(scope="module")
def pools(duck):
    """Forty nearest rows of each query: id, score, unit vector, source; best first."""
    e = duck.execute("select vec_id, embedding::double[], label from embeddings order by vec_id").fetchall()
    v = np.array([r[1] for r in e])
    v /= np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for i, r in enumerate(e):
        if r[0] % 50 == 0:
            s = np.round(v @ v[i], 6)
            out[r[0]] = sorted(((e[j][0], s[j], v[j], e[j][2]) for j in range(len(e)) if j != i), key=lambda x: (-x[1], x[0]))[:40]
    return out


def picks(pool, k, value, allowed=lambda out, x: True):
    out = []
    while len(out) < k:
        open_ = [x for x in pool if all(x[0] != y[0] for y in out) and allowed(out, x)]
        if not open_:
            break
        out.append(max(open_, key=lambda x: value(x, max((float(x[2] @ y[2]) for y in out), default=0.0))))
    return [x[0] for x in out]


def chosen(spark, name):
    got = {}
    for r in QUERIES[name](spark, DATA).collect():
        got.setdefault(r.q, []).append((r.place, r.vec_id))
    return {q: [i for _, i in sorted(x)] for q, x in got.items()}


def test_mmr(spark, pools):
    assert chosen(spark, "q083_mmr_lambda") == {q: picks(p, 5, lambda x, near: 0.62 * x[1] - 0.38 * near) for q, p in pools.items()}


def test_mmr_after_the_filter(spark, pools):
    kept = {q: [(i, (s + 1) / 2, v, g) for i, s, v, g in p if (s + 1) / 2 >= 0.65] for q, p in pools.items()}
    assert chosen(spark, "q088_filter_then_mmr") == {q: picks(p, 3, lambda x, near: 0.62 * x[1] - 0.38 * near) for q, p in kept.items() if p}


def test_mmr_with_a_cap_for_each_source(spark, pools):
    want = {}
    for q, p in pools.items():
        gamma = np.clip(0.55 + (0.10 - np.std([x[1] for x in p])) * 1.5, 0.35, 0.75)
        want[q] = picks(p, 6, lambda x, near: x[1] - gamma * near, lambda out, x: sum(y[3] == x[3] for y in out) < 2)
    assert chosen(spark, "q084_mmr_per_source") == want


def test_interleaving(spark, duck):
    groups = {}
    for i, url in duck.execute("select page_id, url from pages order by page_id").fetchall():
        host = urlparse(url).hostname.removeprefix("www.")
        groups.setdefault(i // 100, {}).setdefault(i % 3, []).append((i, host))
    want = {}
    for q, providers in groups.items():
        rest, seen, out = [providers[k] for k in sorted(providers)], set(), []
        while any(rest) and len(out) < 12:
            for k, queue in enumerate(rest):
                queue = [x for x in queue if x[1] not in seen]
                if queue and len(out) < 12:
                    seen.add(queue[0][1])
                    out.append(queue[0][0])
                rest[k] = queue[1:]
        want[q] = out
    got = {}
    for r in QUERIES["q093_interleave_merge"](spark, DATA).orderBy("q", "place").collect():
        got.setdefault(r.q, []).append(r.page_id)
    assert got == want


def test_search_with_noise_and_sampling(spark, duck):
    e = duck.execute("select vec_id, embedding::double[] from embeddings order by vec_id").fetchall()
    v = np.array([r[1] for r in e])
    v /= np.linalg.norm(v, axis=1)[:, None]
    got = {}
    for r in QUERIES["q111_diverse_atom_search"](spark, DATA).collect():
        got.setdefault(r.query, []).append((r.place, r.vec_id, r.score))
    for q in [r[0] for r in e if r[0] % 50 == 0]:
        w = v[q] + 0.05 * np.random.default_rng([11, q]).normal(size=64)
        score = {i: s for i, s in zip((r[0] for r in e), np.round(v @ (w / np.linalg.norm(w)), 6)) if i not in (3, 77, 120)}
        fetched = sorted(score, key=lambda i: (-score[i], i))[: max(6 * 4, 6 + 3 + 8)]
        kept = [(i, score[i], v[i]) for i in fetched if i % 37 != 5 and i % 11 != 4 and i != 51 and score[i] >= 0][:30]
        pool = picks(kept, 12, lambda x, near: 0.62 * x[1] - 0.38 * near)
        found = [i for _, i, _ in sorted(got[q])]
        assert len(found) == 6 and set(found) <= set(pool) and [score[i] for i in found] == sorted((score[i] for i in found), reverse=True)


def test_near_equal_facts(spark, duck):
    groups = {}
    for c, turn, text in duck.execute("select conv_id, turn, text from conversations order by conv_id, turn").fetchall():
        kept = groups.setdefault(c, [])
        if all(SequenceMatcher(None, text.lower(), k.lower()).ratio() < 0.90 for _, k in kept):
            kept.append((turn, text))
    assert sorted((r.grp, r.id) for r in QUERIES["q054_text_overlap_join"](spark, DATA).collect()) == sorted((c, i) for c, k in groups.items() for i, _ in k)


def test_distinct_lines(spark, duck):
    want = []
    for d, text in duck.execute("select doc_id, text from documents").fetchall():
        kept = []
        for i, line in enumerate((text or "").split("\n")):
            t = line.strip().lower()
            if t and not any(t == k or (len(t) > 20 and (t in k or k in t)) for k in kept):
                kept.append(t)
                want.append((d, i))
    assert sorted(map(tuple, QUERIES["q132_line_dedup"](spark, DATA).collect())) == sorted(want)


def test_repaired_graphs(spark, duck):
    n = duck.execute("select count(*) from part").fetchone()[0]
    edges = {(p, p // 40 * 40 + x) for p in duck.execute("select p_partkey from part").df().p_partkey.tolist() for k in [p % 40] for x in (k // 2, k // 3, *([2 * k % 40] if k % 7 == 0 else []))}
    edges = {(c, p) for c, p in edges if c != p}
    got = {(r.child, r.parent) for r in QUERIES["q134_cycle_repair"](spark, DATA).collect()}
    before = {c: [p for x, p in sorted(got) if x == c] for c in range(n + 40)}

    def climbs(node, trail):
        return node in trail or any(climbs(p, trail | {node}) for p in before.get(node, ()))

    assert got < edges and not any(climbs(c, frozenset()) for c in range(n))
    gone = edges - got
    assert gone and all(sum(c // 40 == g for c, _ in gone) <= 16 for g in range(n // 40 + 1))
    onward = {c: [p for x, p in edges if x == c] for c, _ in edges}

    def reaches(start, goal, seen):
        return start == goal or any(reaches(p, goal, seen | {start}) for p in onward.get(start, ()) if p not in seen)

    assert all(reaches(p, c, frozenset()) for c, p in gone)  # every edge taken out lay on a cycle


def test_paragraphs(spark, duck):
    from html.parser import HTMLParser

    skipped = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
    blocks = {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "td", "th", "tr", "ul", "ol", "pre", "blockquote"}

    class Events(HTMLParser):
        def __init__(self):
            super().__init__()
            self.events = []

        def handle_starttag(self, tag, attrs):
            self.events.append(("+", tag))

        def handle_endtag(self, tag):
            self.events.append(("-", tag))

        def handle_data(self, data):
            self.events.append(("t", data))

    want = []
    for page, html in duck.execute("select page_id, html from pages").fetchall():
        p = Events()
        p.feed(html)
        p.close()
        depth, text = 0, ""
        for kind, x in p.events:
            depth = depth + (x in skipped) if kind == "+" else max(0, depth - (x in skipped)) if kind == "-" else depth
            text += x if kind == "t" and not depth else "\0" if kind != "t" and x in blocks else ""
        found = [q for q in (" ".join(x.split()) for x in text.split("\0")) if q]
        want += [(page, i, q) for i, q in enumerate(x for x in found if len(x) >= 40)]
    assert sorted(map(tuple, QUERIES["q144_paragraphs"](spark, DATA).collect())) == sorted(want)


def test_tokenizer_branch(spark, duck):
    import public_tokenizers
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(c, t, len(code.encode(x or "", add_special_tokens=False).ids)) for c, t, x in duck.execute("select conv_id, turn, text from conversations").fetchall()]
    assert sorted(map(tuple, QUERIES["q151_tokenizer_branch"](spark, DATA).collect())) == sorted(want)


def test_folder_of_files(spark, tmp_path):
    import hashlib
    from pathlib import Path

    from tidewell.plans import registry
    from tidewell.sources.folder import corpus, read_files

    own = {p.stem: p.read_text(encoding="utf-8") for p in Path(registry.__file__).parent.glob("*.py")}
    got = {r.module: r.digest for r in QUERIES["q021_folder_corpus"](spark, DATA).collect()}
    assert got == {k: hashlib.sha256((v + "\n").encode()).hexdigest() for k, v in own.items() if v.strip() and len(v.encode()) < 100 * 1024}
    for name, raw in {"b/a.py": b"x = 1\n", "README.md": b" hi ", "node_modules/x.js": b"1", "big.py": b"#" * 200_000, "bin.c": b"a\0b", "odd.txt": b"\xffz", "empty.py": b" \n", "pic.png": b"png"}.items():
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_bytes(raw)
    files = read_files(spark, str(tmp_path / "repo"))
    assert sorted(r.path for r in files.collect()) == ["README.md", "b/a.py", "odd.txt"]
    assert corpus(files).first() == ("### README.md\nhi\n\n### b/a.py\nx = 1\n\n### odd.txt\n�z", 3)


def test_stale_jobs_are_queued_again_by_a_timer(spark, tmp_path):
    import time

    from tidewell.streaming.rates import job_states
    from tidewell.streaming.run import stream_folder

    rows = spark.createDataFrame([(1, "pending", "2024-01-01 00:00:00"), (1, "running", "2024-01-01 00:00:01"), (2, "pending", "2024-01-01 00:00:00")], "job long, status string, ts string").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    seen = []
    states = job_states(stream_folder(spark, str(tmp_path / "s"), rows), "job", "status", "ts", stale="1 seconds")
    q = states.writeStream.foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 40
        while time.time() < until and (1, "pending", 3) not in seen:
            time.sleep(0.3)
    finally:
        q.stop()
    assert sorted(seen) == [(1, "pending", 1), (1, "pending", 3), (1, "running", 2), (2, "pending", 1)]
