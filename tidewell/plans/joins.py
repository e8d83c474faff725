"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import texts, urls
from tidewell.operators import ranking as rank
from tidewell.operators import tables as ops
from tidewell.plans.registry import Tables, query
from tidewell.plans.scans import HOST_SQL


@query("q048_containment_overlap", """
with n as (select p_partkey, unnest(string_split(lower(p_name), ' ')) as entity from part), m as (select distinct lower(split_part(p_name, ' ', 1)) as label from part where p_partkey % 50 = 0),
h as (select p_partkey, entity, exists (select 1 from m where entity = label or contains(entity, label) or contains(label, entity)) as hit from n)
select p_partkey, round(count(*) filter (where hit) / count(*), 6) as ratio from h group by p_partkey""")
def q048(t: Tables) -> DataFrame:
    """Share of a node's entities that equal, hold or lie in a mastered label; distinct ones meet by a shared run of characters."""
    from tidewell.operators.matching import containment

    n = t.part.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("entity"))
    m = t.part.where("p_partkey % 50 = 0").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("label")).distinct()
    hit = containment(n.select("entity").distinct(), m, "entity", "label").select("entity").distinct().withColumn("hit", F.lit(1))
    return n.join(hit, "entity", "left").groupBy("p_partkey").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("ratio"))


@query("q049_registry_lookup", "select o.o_orderkey as node, u.id as source_id, s.s_name from orders o, lateral (select unnest([o_orderkey % 100, (o_orderkey * 7) % 130]) as id) u join supplier s on s.s_suppkey = u.id")
def q049(t: Tables) -> DataFrame:
    ids = F.array(F.col("o_orderkey") % 100, (F.col("o_orderkey") * 7) % 130)
    nodes = t.orders.select(F.col("o_orderkey").alias("node"), F.explode(ids).alias("source_id"))
    return nodes.join(t.supplier.withColumnRenamed("s_suppkey", "source_id"), "source_id").select("node", "source_id", "s_name")


@query("q050_trust_enrichment", "select d.doc_id, greatest(coalesce(l.quality, 0), d.doc_id % 3 - 1)::bigint as trust, l.toxic::bigint as toxic from documents d left join labels l using (doc_id)")
def q050(t: Tables) -> DataFrame:
    """The larger of known and hinted trust; documents without hint stay."""
    trust = F.greatest(F.coalesce("quality", F.lit(0)), F.col("doc_id") % 3 - 1)
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", trust.cast("long").alias("trust"), F.col("toxic").cast("long").alias("toxic"))


@query("q051_allow_list_semi_join", "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def q051(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("q052_exclude_anti_join", r"with e as (select distinct regexp_replace(lower(trim(url)), '/+$', '') k from pages where page_id % 3 = 0), r as (select page_id, regexp_replace(lower(trim(url)), '/+$', '') k from pages) select min(page_id) as page_id from r where k not in (select k from e) group by k")
def q052(t: Tables) -> DataFrame:
    keyed = t.pages.select("page_id", urls.strip_slash("url").alias("k"))
    left = ops.delete_where(keyed, keyed.where("page_id % 3 = 0").select("k"), "k")
    return ops.first_wins(left, "k", "page_id").select("page_id")


@query("q053_similarity_self_join", """
with v as (select vec_id, label, embedding::double[] e from embeddings)
select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.e, b.e), 6) as score from v a join v b on a.label = b.label and a.vec_id < b.vec_id where round(list_cosine_similarity(a.e, b.e), 9) >= 0.3""")
def q053(t: Tables) -> DataFrame:
    """Pairs of one entity group that are near enough."""
    from tidewell.operators.dedup import similar_pairs

    return similar_pairs(t.embeddings, "vec_id", "embedding", 0.3, within=["label"]).withColumn("score", F.round("score", 6))


COPIED_SQL = "v as (select vec_id, label, embedding from embeddings union all select vec_id + 1000000, label, embedding from embeddings where vec_id % 3 = 0)"


def copied(t: Tables) -> DataFrame:
    """The vectors, a third of them twice."""
    v = t.embeddings.select("vec_id", "label", "embedding")
    return v.union(v.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))


@query("q053_similarity_classes", f"""
with {COPIED_SQL}, c as (select label, embedding::double[] e, min(vec_id) as head, count(*) as n from v where embedding is not null group by all)
select a.head as a, b.head as b, round(list_cosine_similarity(a.e, b.e), 6) as score, a.n as a_rows, b.n as b_rows from c a join c b on a.label = b.label and a.head < b.head where round(list_cosine_similarity(a.e, b.e), 9) >= 0.3""")
def q053_classes(t: Tables) -> DataFrame:
    """Near pairs between classes of equal vectors, not between their copies."""
    from tidewell.operators.dedup import similar_classes

    return similar_classes(copied(t), "vec_id", "embedding", 0.3, within=["label"]).withColumn("score", F.round("score", 6))


@query("q053_class_members", f"with {COPIED_SQL} select vec_id as key, min(vec_id) over (partition by label, embedding) as head from v where embedding is not null")
def q053_members(t: Tables) -> DataFrame:
    from tidewell.operators.dedup import vector_classes

    return vector_classes(copied(t), "vec_id", "embedding", within=["label"])


@query("q054_text_overlap_join")
def q054(t: Tables) -> DataFrame:
    """Facts by weight, each kept unless it nearly equals a kept one of its group."""
    from tidewell.operators.greedy import distinct_texts

    facts = t.conversations.select(F.col("conv_id").alias("grp"), F.col("turn").alias("id"), "text", (-F.col("turn")).cast("double").alias("score"))
    return distinct_texts(facts, ["grp"], "id", "text", "score", threshold=0.90).select("grp", "id")


STATEMENTS_SQL = "s as (select doc_id, i, lower(trim(x[i])) as t from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from (select doc_id, string_split(replace(text, chr(10), ' '), '. ') as x from documents)) where trim(x[i]) <> '')"


@query("q055_containment_join", f"""
with {STATEMENTS_SQL}, clean as (select distinct doc_id, trim(regexp_replace(t, '^[^ ]+', '')) as c from s)
select c.doc_id, c as clean, array_to_string(list_sort(list_distinct(list(i))), ',') as chunks from clean c join s on s.doc_id = c.doc_id and (s.t = c.c or contains(s.t, c.c) or contains(c.c, s.t)) where c.c <> '' group by all""")
def q055(t: Tables) -> DataFrame:
    """Clean statements of a document, here without their first word, with the chunks of all raw ones that hold them or lie in them."""
    from tidewell.operators.matching import containment_within

    parts = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")
    raw = t.documents.select("doc_id", F.posexplode(parts).alias("i", "x")).select("doc_id", (F.col("i") + 1).cast("long").alias("chunk"), F.lower(F.trim("x")).alias("raw")).where("raw <> ''")
    clean = raw.select("doc_id", F.trim(F.regexp_replace("raw", "^[^ ]+", "")).alias("clean"))
    met = containment_within(clean, raw, ["doc_id"], "clean", "raw", "chunk")
    return met.select("doc_id", "clean", F.array_join(F.transform("chunk", lambda x: x.cast("string")), ",").alias("chunks"))


EDGES_SQL = "with e as (select p_partkey as child, p_partkey // 40 as graph, 40 * (p_partkey // 40) + unnest([p_partkey % 40 // 2, p_partkey % 40 // 3, case when p_partkey % 40 % 7 = 0 then 2 * (p_partkey % 40) % 40 end]) as parent from part), g as (select distinct child, parent, graph from e where parent is not null and parent <> child)"


def edges(t: Tables) -> DataFrame:
    """Prerequisite graphs of forty nodes each over all parts, with a few cycles."""
    k = F.col("p_partkey") % 40
    parents = F.array(F.floor(k / 2), F.floor(k / 3), F.when(k % 7 == 0, 2 * k % 40))
    graph = F.floor(F.col("p_partkey") / 40)
    e = t.part.select(F.col("p_partkey").alias("child"), graph.alias("graph"), F.explode(parents).alias("parent")).where("parent IS NOT NULL")
    return e.select("child", (F.col("graph") * 40 + F.col("parent")).alias("parent"), "graph").where("parent <> child").distinct()


@query("q056_neighbours", EDGES_SQL + ", n as (select distinct child as node from g union select distinct parent from g), b as (select child as node, list_sort(list(parent)) as p from g group by child), a as (select parent as node, list_sort(list(child)) as c from g group by parent) select node, coalesce(array_to_string(p, ','), '') as before, coalesce(array_to_string(c, ','), '') as after from n left join b using (node) left join a using (node)")
def q056(t: Tables) -> DataFrame:
    from tidewell.operators.graphs import neighbours

    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return neighbours(edges(t)).select("node", text("before"), text("after"))


@query("q057_high_water_sync", "with s as (select user_id, max(ts) as synced from events where event_id % 10 = 0 group by user_id) select e.event_id from events e join s using (user_id) where e.ts > s.synced")
def q057(t: Tables) -> DataFrame:
    """Only what changed after each user's last sync."""
    synced = t.events.where("event_id % 10 = 0").groupBy("user_id").agg(F.max("ts").alias("synced"))
    return t.events.join(synced, "user_id").where("ts > synced").select("event_id")


REGISTRY_SQL = r"""
with p as (select page_id, page_id // 40 as course, regexp_replace(lower(trim(url)), '/+$', '') as k from pages),
r as (select course, page_id as pos, page_id % 40 + 1 as id, k from p where page_id % 3 <> 0),
known as (select course, k, arg_max(id, pos) as id from r where k <> '' group by all),
n as (select course, 3 * page_id as pos, k from p union all select course, 3 * page_id + 1, k from p where page_id % 3 = 0 union all select course, 3 * page_id + 2, '' from p where page_id % 7 = 0),
m as (select n.course, n.pos, case when n.k = '' then '#' || n.pos::varchar else n.k end as own, known.id from n left join known on known.course = n.course and known.k = n.k),
f as (select course, own, min(pos) as first from m where id is null group by all), o as (select *, row_number() over (partition by course order by first) as nth from f),
h as (select course, count(*) as n, list(id) as used from r group by course),
v as (select course, id, row_number() over (partition by course order by id) as nth from (select course, unnest(list_filter(range(n + 1, n + 201), lambda x: not list_contains(used, x))) as id from h)),
made as (select o.course, o.own, o.first, v.id from o join v on v.course = o.course and v.nth = o.nth)"""


def registry_patch(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Registries of forty pages each, with gaps in their numbers; new rows repeat known and new URLs in other spellings, some without URL."""
    from tidewell.operators.matching import patch_registry

    p = t.pages.select("page_id", "url", F.floor(F.col("page_id") / 40).alias("course"))
    registry = p.where("page_id % 3 <> 0").select("course", F.col("page_id").alias("pos"), (F.col("page_id") % 40 + 1).alias("source_id"), "url")
    spelled = p.select("course", (3 * F.col("page_id")).alias("pos"), F.concat(F.upper("url"), F.lit("//")).alias("url"))
    again = p.where("page_id % 3 = 0").select("course", (3 * F.col("page_id") + 1).alias("pos"), "url")
    blank = p.where("page_id % 7 = 0").select("course", (3 * F.col("page_id") + 2).alias("pos"), F.lit(" ").alias("url"))
    mapped = p.where("page_id % 5 = 0 AND page_id % 3 <> 0").select("course", (F.col("page_id") % 40 + 1).alias("source_id"))
    return patch_registry(registry, spelled.unionByName(again).unionByName(blank), mapped, ["course"], "url", "source_id", "pos", cap=32)


@query("q058_registry_patch", REGISTRY_SQL + " select m.course, m.pos, coalesce(m.id, made.id)::bigint as source_id from m left join made on made.course = m.course and made.own = m.own")
def q058(t: Tables) -> DataFrame:
    """Known URLs keep their number, new ones take the next free one, once for each URL."""
    return registry_patch(t)[0].select("course", "pos", "source_id")


@query("q058_registry_cap", REGISTRY_SQL + """,
a as (select course, id, 0 as part, pos as spot from r union all select course, id, 1, first from made), q as (select a.*, a.part = 0 and a.spot % 5 = 0 as pin from a),
w as (select *, count(*) over (partition by course) as n, count(*) filter (where pin) over (partition by course) as pins, row_number() over (partition by course, pin order by part, spot) as rest from q)
select course, row_number() over (partition by course order by case when n > 32 and not pin then 1 else 0 end, part, spot) as place, id::bigint as source_id from w where n <= 32 or pin or rest <= 32 - pins""")
def q058_cap(t: Tables) -> DataFrame:
    """The registries after the patch: beyond the cap mapped entries stay, then the first of the others."""
    return registry_patch(t)[1].select("course", "place", F.col("source_id").cast("long").alias("source_id"))


@query("q058_table_ids", r"""
with p as (select page_id, regexp_replace(lower(trim(url)), '/+$', '') as k from pages), r as (select k, min(page_id) as id from p where page_id % 4 = 0 group by k), n as (select 2 * page_id as pos, k from p union all select 2 * page_id + 1, k from p where page_id % 2 = 1),
m as (select n.pos, n.k, r.id from n left join r using (k)), f as (select k, row_number() over (order by min(pos)) as nth from m where id is null group by k)
select pos, coalesce(m.id, (select max(page_id) from p where page_id % 4 = 0) + nth)::bigint as source_id from m left join f using (k)""")
def q058_table(t: Tables) -> DataFrame:
    """One registry for the whole table: new keys are numbered by ranges."""
    from tidewell.operators.matching import allocate_ids

    p = t.pages.select("page_id", urls.strip_slash("url").alias("k"))
    rows = p.select((2 * F.col("page_id")).alias("pos"), "k").union(p.where("page_id % 2 = 1").select(2 * F.col("page_id") + 1, "k"))
    return allocate_ids(p.where("page_id % 4 = 0").select("k", F.col("page_id").alias("source_id")), rows, "k", "source_id", "pos").select("pos", "source_id")


@query("q059_anchor_expansion", """
with q as (select vec_id as query, embedding::double[] v from embeddings where vec_id % 50 = 0), s as (select query, vec_id, vec_id % 25 as doc, round(list_cosine_similarity(embedding::double[], v), 6) score from embeddings, q), a as (select query, doc as first from s qualify row_number() over (partition by query order by score desc, vec_id) = 1),
x as (select query, vec_id, doc, 0 as part, vec_id as ord, 0.0 as neg from s join a using (query) where doc = first), y as (select query, vec_id, doc, 1 as part, 0 as ord, -score as neg from s join a using (query) where doc <> first qualify row_number() over (partition by query order by score desc, vec_id) <= 2)
select query, vec_id, doc, row_number() over (partition by query order by part, ord, neg, vec_id) as place from (select * from x union all select * from y)""")
def q059(t: Tables) -> DataFrame:
    """For each query all chunks of the winning document in order, then two others."""
    from tidewell.operators.retrieval import anchor_first
    from tidewell.plans.search import pairs_of

    rows = t.embeddings.select("vec_id", "embedding", (F.col("vec_id") % 25).alias("doc"))
    s = pairs_of(t, rows, keep=2, within=["doc"]).select("query", "vec_id", "doc", "score")
    return anchor_first(s, ["query"], "doc", "vec_id", "score", supplements=2, rows=rows.select("vec_id", "doc")).select("query", "vec_id", "doc", "place")
