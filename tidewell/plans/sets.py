"""Set operations, duplicates, clusters and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import urls
from tidewell.operators import dedup, graphs, greedy
from tidewell.operators import tables as ops
from tidewell.plans.filters import PAGE_KIND, varied
from tidewell.plans.joins import EDGES_SQL, edges
from tidewell.plans.registry import Tables, query

KEY_SQL = r"regexp_replace(lower(trim(url)), '/+$', '')"


@query("q122_url_dedup", rf"with u as (select page_id, case when page_id % 3 = 0 then upper(url) || '/' else url end as url from pages union all select page_id + 5000, url from pages where page_id % 2 = 0), r as (select page_id, row_number() over (partition by {KEY_SQL} order by page_id) rn from u) select page_id from r where rn = 1")
def q122(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.upper("url"), F.lit("/"))).otherwise(F.col("url")).alias("url"))
    u = p.union(t.pages.where("page_id % 2 = 0").select(F.col("page_id") + 5000, "url"))
    return ops.first_wins(u, urls.strip_slash("url"), "page_id").select("page_id")


@query("q123_batch_merge", "with b as (select 1 as batch, doc_id as pos, source || ':' || lang as k from documents where doc_id % 2 = 0 union all select 2, doc_id, source || ':' || lang from documents), r as (select *, row_number() over (partition by k order by batch, pos) rn from b) select batch::bigint as batch, pos, k from r where rn = 1 order by batch, pos limit 50")
def q123(t: Tables) -> DataFrame:
    """Batches in order, first of each key, up to the cap."""
    d = t.documents.select(F.col("doc_id").alias("pos"), F.concat_ws(":", "source", "lang").alias("k"))
    b = d.where("pos % 2 = 0").withColumn("batch", F.lit(1).cast("long")).unionByName(d.withColumn("batch", F.lit(2).cast("long")))
    return ops.first_wins(b, "k", "batch", "pos").orderBy("batch", "pos").limit(50).select("batch", "pos", "k")


PAIRS_SQL = "v as (select vec_id, label, embedding::double[] e from embeddings), l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id < b.vec_id and a.label = b.label where round(list_cosine_similarity(a.e, b.e), 9) >= 0.3), e2 as (select a x, b y from l union select b, a from l), reach(x, y) as (select vec_id, vec_id from v union select r.x, e2.y from reach r join e2 on e2.x = r.y), comp as (select x as vec_id, min(y) as component from reach group by x)"


def clusters(t: Tables) -> DataFrame:
    pairs = dedup.similar_pairs(t.embeddings, "vec_id", "embedding", 0.3, within=["label"], forest=True)
    return dedup.components(t.embeddings.select(F.col("vec_id").alias("node")), pairs)


@query("q124_representatives", f"with recursive {PAIRS_SQL} select distinct component as vec_id from comp")
def q124(t: Tables) -> DataFrame:
    """The first member of each component stays."""
    return clusters(t).select(F.col("component").alias("vec_id")).distinct()


@query("q125_merge_by_message", "with h as (select conv_id, turn, text from conversations where turn % 3 <> 0), w as (select conv_id, turn, 'new: ' || text as text from conversations where turn % 2 = 0) select conv_id, turn, coalesce(w.text, h.text) as text from h full outer join w using (conv_id, turn)")
def q125(t: Tables) -> DataFrame:
    """The window's row overrides the history's."""
    c = t.conversations
    h = c.where("turn % 3 <> 0").select("conv_id", "turn", F.col("text").alias("h"))
    w = c.where("turn % 2 = 0").select("conv_id", "turn", F.concat(F.lit("new: "), "text").alias("w"))
    return h.join(w, ["conv_id", "turn"], "full_outer").select("conv_id", "turn", F.coalesce("w", "h").alias("text"))


@query("q126_text_hash_dedup", "with d as (select doc_id, case when doc_id % 50 = 0 then ' ' else text end as text from documents), r as (select doc_id, trim(text) = '' as blank, row_number() over (partition by sha1(trim(text)) order by doc_id) rn from d) select doc_id from r where blank or rn = 1")
def q126(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("text")).alias("text"))
    return dedup.hash_dedup(d, "text", "doc_id").select("doc_id")


URL_CASES = [(1, "https://arxiv.org/abs/2512.08290"), (2, "https://arxiv.org/pdf/2512.08290.pdf"), (3, "https://doi.org/10.48550/arXiv.2203.08975v2"), (4, "https://doi.org/10.5281/zenodo.1234567"), (5, "https://doi.org/10.48550/arxiv.hep-th/9901001"), (6, "http://x.org/A/b?q=1"), (7, "http://y.org/A/b/"), (8, "https://z.org/"), (9, "https://doi.org/10.1101/2020.01.02.123456v3"), (10, "https://arxiv.org/abs/2512.08290/"), (11, "")]
DOI_KIND = "case page_id % 6 when 0 then 'https://doi.org/10.48550/arXiv.' || (2000 + page_id % 99)::varchar || '.' || (10000 + page_id)::varchar || 'v' || (page_id % 4)::varchar when 1 then 'https://doi.org/10.5281/zenodo.' || page_id::varchar when 2 then 'https://arxiv.org/abs/' || (2000 + page_id % 99)::varchar || '.' || (10000 + page_id)::varchar when 3 then 'https://doi.org/10.1101/2020.01.02.' || (100000 + page_id)::varchar || 'v2' when 4 then 'https://arxiv.org/pdf/math/' || (1000000 + page_id)::varchar || '.pdf' else url end"
URL_SQL = "(values " + ", ".join(f"({i}, '{u}')" for i, u in URL_CASES) + ") c(id, url)"


@query("q127_source_key", rf"""
with p as (select id, url, trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') as tail, trim(regexp_replace(regexp_extract(url, 'arxiv\.org/(abs|pdf)/(.+)$', 2), '\.pdf$', ''), '/') as aid from (select * from {URL_SQL} union all select page_id + 100, {PAGE_KIND} from pages))
select id::bigint as id, case when aid <> '' then 'arxiv:' || lower(aid) when regexp_matches(tail, '(?i)10\.48550/arxiv\.(\d{{4}}\.\d{{4,5}}|[a-z][a-z\-]*/\d{{4,7}})') then 'arxiv:' || lower(regexp_extract(tail, '(?i)10\.48550/arxiv\.((\d{{4}}\.\d{{4,5}}|[a-z][a-z\-]*/\d{{4,7}})(v\d+)?)', 1)) when tail <> '' then 'doi:' || lower(tail) else {KEY_SQL} end as key from p""")
def q127(t: Tables) -> DataFrame:
    c = t.spark.createDataFrame(URL_CASES, "id long, url string").union(varied(t).select(F.col("page_id") + 100, "url"))
    return c.select("id", urls.source_key("url").alias("key"))


@query("q127_canonical_url", rf"""
with p as (select id, url, trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') as tail, trim(regexp_replace(regexp_extract(url, 'arxiv\.org/(abs|pdf)/(.+)$', 2), '\.pdf$', ''), '/') as aid from (select * from {URL_SQL} union all select page_id + 100, {DOI_KIND} from pages))
select id::bigint as id, case when regexp_matches(tail, '(?i)10\.48550/arxiv\.(\d{{4}}\.\d{{4,5}}|[a-z][a-z\-]*/\d{{4,7}})') then 'https://arxiv.org/pdf/' || regexp_extract(tail, '(?i)10\.48550/arxiv\.((\d{{4}}\.\d{{4,5}}|[a-z][a-z\-]*/\d{{4,7}})(v\d+)?)', 1) || '.pdf'
when regexp_matches(tail, '(?i)10\.1101/\d{{4}}\.\d{{2}}\.\d{{2}}\.\d{{6,9}}') then 'https://www.biorxiv.org/content/10.1101/' || regexp_extract(tail, '(?i)10\.1101/(\d{{4}}\.\d{{2}}\.\d{{2}}\.\d{{6,9}}(v\d+)?)', 1)
when regexp_matches(tail, '(?i)10\.5281/zenodo\.\d+') then 'https://zenodo.org/record/' || regexp_extract(tail, '(?i)10\.5281/zenodo\.(\d+)', 1)
when aid <> '' then 'https://arxiv.org/pdf/' || aid || '.pdf' else url end as canonical from p""")
def q127_canonical(t: Tables) -> DataFrame:
    c = t.spark.createDataFrame(URL_CASES, "id long, url string").union(t.pages.select(F.col("page_id") + 100, F.expr(DOI_KIND.replace("::varchar", ""))))
    return c.select("id", F.coalesce(urls.canonical("url"), urls.pdf_address("url")).alias("canonical"))


@query("q128_streaming_near_duplicates", """
with recursive r as (select vec_id, label as doc, embedding::double[] v, row_number() over (partition by label order by vec_id) rn from embeddings),
b as (select doc, vec_id, rn, [v] as kept, true as ok from r where rn = 1 union all select r.doc, r.vec_id, r.rn, case when list_max(list_transform(kept, lambda k: list_cosine_similarity(k, r.v))) <= 0.25 then list_append(kept, r.v) else kept end, list_max(list_transform(kept, lambda k: list_cosine_similarity(k, r.v))) <= 0.25 from b join r on r.doc = b.doc and r.rn = b.rn + 1)
select doc, vec_id from b where ok""")
def q128(t: Tables) -> DataFrame:
    """Chunks in order of arrival, accepted unless near an accepted one."""
    v = t.embeddings.select("vec_id", "embedding", F.col("label").alias("doc"))
    return greedy.accept_stream(v, ["doc"], "vec_id", "embedding", threshold=0.25).select("doc", "vec_id")


@query("q129_clusters", f"with recursive {PAIRS_SQL} select vec_id, component, count(*) over (partition by component) = 1 as autonomous from comp")
def q129(t: Tables) -> DataFrame:
    c = clusters(t)
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return c.join(sizes, "component").select(F.col("node").alias("vec_id"), "component", (F.col("n") == 1).alias("autonomous"))


@query("q130_canonical_and_aliases", f"with recursive {PAIRS_SQL}, n as (select vec_id, component, coalesce(length(text), 0) as n from comp left join documents on doc_id = vec_id), k as (select component, arg_max(vec_id, (n, -vec_id)) as canonical from n group by component) select vec_id, canonical, vec_id = canonical as is_canonical from comp join k using (component)")
def q130(t: Tables) -> DataFrame:
    """In each suspect group the longest text leads, of equal ones the smallest id; a vector's text is the document of its id."""
    sizes = t.documents.select(F.col("doc_id").alias("node"), F.length("text").alias("n"))
    c = clusters(t).join(sizes, "node", "left")
    k = c.groupBy("component").agg(F.max_by("node", F.struct(F.coalesce("n", F.lit(0)), -F.col("node"))).alias("canonical"))
    return c.join(k, "component").select(F.col("node").alias("vec_id"), "canonical", (F.col("node") == F.col("canonical")).alias("is_canonical"))


@query("q131_code_dedup", r"with c as (select doc_id, sha1(regexp_replace(regexp_replace(text, '#[^\n]*', '', 'g'), '\s+', '', 'g')) as h from documents) select min(doc_id) as canonical, count(*) - 1 as aliases from c group by h having count(*) > 1")
def q131(t: Tables) -> DataFrame:
    """Bundles that agree without comments and white space."""
    h = F.sha1(F.regexp_replace(F.regexp_replace("text", r"#[^\n]*", ""), r"[ \t\n\r\f]+", ""))
    return t.documents.groupBy(h.alias("h")).agg(F.min("doc_id").alias("canonical"), (F.count(F.lit(1)) - 1).alias("aliases")).where("aliases > 0").drop("h")


@query("q132_line_dedup")
def q132(t: Tables) -> DataFrame:
    """Lines of each document that no earlier kept line equals, holds or lies in."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return greedy.distinct_lines(lines, ["doc_id"], "i", "line").select("doc_id", "i")


@query("q133_dag_checks", """
with recursive n as (select p_partkey as node from part), e as (select p_partkey as child, unnest([p_partkey - p_partkey % 40 + p_partkey % 40 // 2, case when p_partkey % 5 = 0 then p_partkey - p_partkey % 40 + p_partkey % 40 // 3 end, case when p_partkey % 250 = 0 then -1 - p_partkey end, case when p_partkey % 77 = 0 then p_partkey end]) as parent from part where p_partkey % 40 < 38), g as (select distinct child, parent from e where parent is not null),
i as (select g.* from g join n on n.node = g.parent), o as (select parent as node, count(*) as outs from i group by parent), w as (select child as node, count(*) as ins from g group by child), d as (select n.node, coalesce(outs, 0) as outs, coalesce(ins, 0) as ins from n left join o using (node) left join w using (node)),
u as (select child x, parent y from i where child <> parent union select parent, child from i where child <> parent), reach(x, y) as (select node, node from n union select r.x, u.y from reach r join u on u.x = r.y), c as (select x, min(y) c from reach group by x)
select count(*) as nodes, count(*) filter (where ins = 0) as roots, count(*) filter (where outs >= 2) as branches, count(*) filter (where ins >= 2) as merges, count(*) filter (where ins = 1) as single, count(*) filter (where ins = 0 and outs = 0) as orphans, (select count(*) from g where parent not in (select node from n)) as dangling, (select count(*) from g where child = parent) as self_loops, (select count(distinct c) from c) as components from d""")
def q133(t: Tables) -> DataFrame:
    """Graphs of forty nodes over all parts, with dangling edges, loops and orphans."""
    p = F.col("p_partkey")
    k = p % 40
    parents = F.array(p - k + F.floor(k / 2), F.when(p % 5 == 0, p - k + F.floor(k / 3)), F.when(p % 250 == 0, -1 - p), F.when(p % 77 == 0, p))
    e = t.part.where("p_partkey % 40 < 38").select(p.alias("child"), F.explode(parents).alias("parent")).where("parent IS NOT NULL").distinct()
    return graphs.topology(t.part.select(p.alias("node")), e)


@query("q134_cycle_members", EDGES_SQL.replace("with e", "with recursive e") + ", r(a, b) as (select child, parent from g union select r.a, g.parent from r join g on g.child = r.b) select distinct a as node from r where a = b")
def q134(t: Tables) -> DataFrame:
    return graphs.on_cycles(edges(t))


@query("q134_strong_components", """
with recursive p as (select p_partkey as n, p_partkey // 120 as b, p_partkey % 120 as i from part),
e as (select n as child, case when i = 110 then n - 110 else n + 1 end as parent from p where i <= 110 and n + 1 <= (select max(n) from p) union select n, n - 3 from p where i % 10 = 9 and i > 110 union select n, n + 120 from p where i = 5 union select n, n + 2 from p where i > 110),
g as (select distinct child, parent from e where child <> parent), r(a, b) as (select child, parent from g union select r.a, g.parent from r join g on g.child = r.b),
k as (select r.a as node, min(r.b) as m from r join r as s on s.a = r.b and s.b = r.a group by r.a), a as (select n as node from p union select child from g union select parent from g)
select a.node, least(a.node, coalesce(m, a.node)) as component from a left join k using (node)""")
def q134_components(t: Tables) -> DataFrame:
    """Rings of 111 nodes, chains between them and edges that close none."""
    p, last = F.col("p_partkey"), t.part.agg(F.max("p_partkey").alias("last"))
    i = p % 120
    n = t.part.select("p_partkey").crossJoin(F.broadcast(last))  # one row
    ring = n.where((i <= 110) & (p + 1 <= F.col("last"))).select(p.alias("child"), F.when(i == 110, p - 110).otherwise(p + 1).alias("parent"))
    more = n.select(p.alias("child"), F.explode(F.array(F.when((i % 10 == 9) & (i > 110), p - 3), F.when(i == 5, p + 120), F.when(i > 110, p + 2))).alias("parent"))
    return graphs.strong_components(t.part.select(p.alias("node")), ring.union(more.where("parent IS NOT NULL")))


@query("q134_cycle_repair")
def q134_repair(t: Tables) -> DataFrame:
    """Edges left when each graph's cycles are broken, one edge a step; edges of new nodes go first."""
    return graphs.break_cycles(edges(t), ["graph"], prefer=F.col("node") % 40 >= 20).select("graph", "child", "parent")


@query("q135_hierarchy_walk", "with recursive h(node, ancestor, level) as (select p_partkey, p_partkey, 0::bigint from part union all select node, ancestor // 2, level + 1 from h where ancestor // 2 >= 1) select * from h")
def q135(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    return graphs.walk_up(t.part.select(p.alias("node"), F.when(p >= 2, F.floor(p / 2)).alias("parent")))


@query("q136_import_graph", "select p_partkey, unnest(list_distinct(['pkg/' || split_part(lower(p_name), ' ', 1) || '.py', 'pkg/' || split_part(lower(p_name), ' ', 2) || '.py'])) as path from part")
def q136(t: Tables) -> DataFrame:
    """Local imports of code to candidate files."""
    from tidewell.functions.code import local_imports

    code = t.part.select("p_partkey", F.concat(F.lit("import os\nfrom ."), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(" import x\nfrom pkg."), F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit(" import y\n")).alias("code"))
    return code.select("p_partkey", F.explode(local_imports("code", F.lit("pkg"))).alias("path"))
