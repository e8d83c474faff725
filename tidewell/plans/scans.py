"""Sources, sinks and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.texts import blocks_of, heading_blocks
from tidewell.functions.urls import host, strip_slash
from tidewell.functions.vectors import cosine
from tidewell.operators import tables as ops
from tidewell.operators.ranking import top_per_group
from tidewell.plans.registry import Tables, query
from tidewell.plans.search import pairs_of
from tidewell.streaming.run import scratch


@query("q001_vector_table_create", "select vec_id::varchar as id, label::varchar as label, 'm' || (label % 2)::varchar as embed_model, len(embedding)::bigint as dim, true as made, false as made_again from embeddings")
def q001(t: Tables) -> DataFrame:
    """Create a table once and fill it; a second create changes nothing."""
    from tidewell.sources.vector_table import VectorTable

    table = VectorTable(t.spark, scratch(t.spark, "vectors"))
    made = table.create()
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("payload"), F.concat(F.lit("m"), F.col("label") % 2).alias("embed_model"))
    table.upsert(rows)
    again = table.create()
    return table.rows().select("id", F.col("payload")["label"].alias("label"), "embed_model", F.size("embedding").cast("long").alias("dim"), F.lit(made).alias("made"), F.lit(again).alias("made_again"))


@query("q002_upsert", """
with base as (select vec_id, label from embeddings where vec_id % 4 <> 1),
u as (select vec_id, label + 100 as label, 1 as version from embeddings where vec_id % 3 = 0 union all select vec_id, label + 200, 2 from embeddings where vec_id % 6 = 0 union all select vec_id + 100000, label, 1 from embeddings where vec_id % 5 = 0),
n as (select vec_id, label from (select *, row_number() over (partition by vec_id order by version desc) rn from u) where rn = 1)
select vec_id, label from n union all select vec_id, label from base where vec_id not in (select vec_id from n)""")
def q002(t: Tables) -> DataFrame:
    """Of two updates of one version, which tables of more than 100,000 rows have, the first batch's stays."""
    e = t.embeddings.select("vec_id", "label")
    new = e.where("vec_id % 3 = 0").selectExpr("vec_id", "label + 100 AS label", "1 AS version", "1 AS batch").union(e.where("vec_id % 6 = 0").selectExpr("vec_id", "label + 200", "2", "2")).union(e.where("vec_id % 5 = 0").selectExpr("vec_id + 100000", "label", "1", "3"))
    return ops.upsert(e.where("vec_id % 4 <> 1"), new, "vec_id", F.desc("version"), F.asc("batch"))


@query("q003_row_id", """
with h as (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id::varchar || ':0:' || text)) d from documents)
select doc_id, substr(d,1,8)||'-'||substr(d,9,4)||'-5'||substr(d,14,3)||'-'||substr('89ab', (('0x'||substr(d,17,1))::int % 4)::int + 1, 1)||substr(d,18,3)||'-'||substr(d,21,12) as row_id from h""")
def q003(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ops.row_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("row_id"))


@query("q004_point_lookup", "select doc_id, lang, source from documents where source = 'src3' order by doc_id limit 1")
def q004(t: Tables) -> DataFrame:
    return ops.fetch_first(t.documents.select("doc_id", "lang", "source"), "source", "src3", "doc_id")


@query("q005_rows_of_document", "select conv_id, turn, role from conversations where conv_id = 5 order by turn limit 500")
def q005(t: Tables) -> DataFrame:
    return ops.fetch_all(t.conversations.select("conv_id", "turn", "role"), "conv_id", 5, "turn")


@query("q006_delete_by_field", "select doc_id, source from documents where source not in ('src1','src2') and doc_id not in (select doc_id from labels where quality = 0)")
def q006(t: Tables) -> DataFrame:
    gone = t.spark.createDataFrame([("src1",), ("src2",)], "source string")
    left = ops.delete_where(t.documents.select("doc_id", "source"), F.broadcast(gone), "source")  # a fixed list
    return ops.delete_where(left, t.labels.where("quality = 0").select("doc_id"), "doc_id").select("doc_id", "source")


@query("q007_embed_space_guard", "select vec_id, label from embeddings where label % 3 = 0")
def q007(t: Tables) -> DataFrame:
    stamped = t.embeddings.withColumn("embed_model", F.when(F.col("label") % 3 == 0, "m1").when(F.col("label") % 3 == 1, " ").otherwise("m2"))
    return ops.of_space(stamped, "m1").select("vec_id", "label")


@query("q008_chunk_sink", """
with c as (select doc_id, source, unnest(range(1, len(b) + 1)) as i, b from (select doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 48) b from documents where doc_id not in (select doc_id from labels where toxic = 1)) where len(b) > 0)
select doc_id::varchar || '_' || i::varchar as chunk_id, doc_id, source, b[i] as chunk_text, i as chunk_index, len(b)::bigint as chunks_in_doc from c""")
def q008(t: Tables) -> DataFrame:
    """Chunks of documents that have no mapped windows yet."""
    fresh = ops.delete_where(t.documents, t.labels.where("toxic = 1").select("doc_id"), "doc_id")
    cut = fresh.select("doc_id", "source", blocks_of("text", "\n", 48).alias("b"))
    each = cut.select("doc_id", "source", F.size("b").cast("long").alias("chunks_in_doc"), F.posexplode("b").alias("i", "chunk_text"))
    return each.select(F.concat_ws("_", "doc_id", F.col("i") + 1).alias("chunk_id"), "doc_id", "source", "chunk_text", (F.col("i") + 1).cast("long").alias("chunk_index"), "chunks_in_doc")


@query("q009_atom_sink", """
select distinct doc_id, trim(s) as statement, md5(doc_id::varchar || ':atom:' || trim(s)) as atom_key from (select doc_id, unnest(string_split(replace(text, chr(10), ' '), '. ')) s from documents) where length(trim(s)) >= 8""")
def q009(t: Tables) -> DataFrame:
    """One row for each distinct statement of a document; its key depends on both."""
    said = t.documents.select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")).alias("s"))
    kept = said.select("doc_id", F.trim("s").alias("statement")).where(F.length("statement") >= 8).distinct()
    return kept.withColumn("atom_key", F.md5(F.concat_ws(":", "doc_id", F.lit("atom"), "statement")))


ARCHIVE_SQL = """
with l as (select *, case when (props->>'$.k')::int % 3 = 0 then null else (props->>'$.k')::int / 100.0 end as trust from events),
a as (select user_id, arg_max(event_type, (ts, event_id)) status, arg_max(trust, (ts, event_id)) filter (where trust is not null) trust, min(ts) first_seen, max(ts) last_seen from l group by user_id)"""


def link_archive(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    log = t.events.select("user_id", "event_id", "ts", F.col("event_type").alias("status"), F.when(k % 3 != 0, k / 100.0).alias("trust"))
    return ops.archive(log, "user_id", "ts", ["status"], ["trust"], "event_id")


@query("q010_link_archive_upsert", ARCHIVE_SQL + " select user_id, status, round(trust, 6) as trust, first_seen, last_seen from a")
def q010(t: Tables) -> DataFrame:
    return link_archive(t).withColumn("trust", F.round("trust", 6))


@query("q011_archive_reuse", ARCHIVE_SQL + " select user_id, status, round(trust, 6) as trust from a where status not in ('error', 'view') and (trust is null or trust >= 0.2) order by trust desc nulls last, last_seen desc, user_id limit 20")
def q011(t: Tables) -> DataFrame:
    return ops.reusable(link_archive(t), ["error", "view"], 0.2, 20, "user_id").select("user_id", "status", F.round("trust", 6).alias("trust"))


HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '')"


@query("q012_domain_blocklist", f"select page_id, {HOST_SQL} as host from pages where {HOST_SQL} not in (select {HOST_SQL} from pages where page_id % 17 = 0)")
def q012(t: Tables) -> DataFrame:
    hosts = t.pages.select("page_id", host("url").alias("host"))
    blocked = ops.distinct_values(hosts.where("page_id % 17 = 0"), "host")
    return ops.delete_where(hosts, blocked, "host").select("page_id", "host")


@query("q013_domain_registry", """
with q as (select vec_id as query, embedding::double[] v from embeddings where vec_id % 50 = 0),
s as (select query, e.vec_id, e.vec_id % 40 as host, round(list_cosine_similarity(e.embedding::double[], q.v), 6) as score from embeddings e, q where e.label % 2 = 0),
d as (select *, row_number() over (partition by query, host order by score desc, vec_id) rn from s where score >= 0.05)
select query, vec_id, host, score from d where rn = 1 qualify row_number() over (partition by query order by score desc, vec_id) <= 8""")
def q013(t: Tables) -> DataFrame:
    """Nearest rows of one class for each query, one for each host."""
    rows = t.embeddings.where("label % 2 = 0").select("vec_id", "embedding", (F.col("vec_id") % 40).alias("host"))
    scored = pairs_of(t, rows, keep=1, within=["host"]).select("query", "vec_id", "host", "score").where("score >= 0.05")
    one = ops.latest(scored, ["query", "host"], F.desc("score"), F.asc("vec_id"))
    return top_per_group(one, ["query"], 8, F.desc("score"), F.asc("vec_id"))


@query("q014_figure_tables", """
with r as (select p.page_id, case when page_id % 2 = 0 then url else 'art:' || substr(md5(url), 1, 8) end as article_id, url from pages p)
select r.page_id, k.page_id as key_page from r join pages k on k.page_id % 10 in (0, 1) and (r.article_id = k.url or right(r.article_id, 9) = ':' || substr(md5(k.url), 1, 8))""")
def q014(t: Tables) -> DataFrame:
    """Rows of an article under its key or under the short hash of its address; both are equality joins."""
    r = t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("art:"), F.substring(F.md5("url"), 1, 8))).alias("article_id"))
    k = t.pages.where("page_id % 10 IN (0, 1)").select(F.col("page_id").alias("key_page"), F.explode(F.array(F.col("url"), F.concat(F.lit(":"), F.substring(F.md5("url"), 1, 8)))).alias("key"))
    r = r.select("page_id", F.explode(F.array_distinct(F.array(F.col("article_id"), F.expr("right(article_id, 9)")))).alias("key"))
    return r.join(k, "key").select("page_id", "key_page").distinct()


@query("q015_cross_node_poles", """
with q as (select vec_id as query, embedding::double[] v from embeddings where vec_id % 50 = 0),
s as (select query, vec_id, label % 2 as polarity, round(list_cosine_similarity(embedding::double[], v), 6) score from embeddings, q where label < 6 and label <> 2),
p as (select * from s qualify row_number() over (partition by query order by score desc, vec_id) <= 12),
r as (select *, row_number() over (partition by query, polarity order by score desc, vec_id) rn from p)
select query, vec_id, polarity, score from r where rn <= 3""")
def q015(t: Tables) -> DataFrame:
    """The twelve nearest rows of each query, then three of each pole."""
    scored = pairs_of(t, t.embeddings.where("label < 6 AND label <> 2"), keep=12).select("query", "vec_id", (F.col("label") % 2).alias("polarity"), "score")
    pool = top_per_group(scored, ["query"], 12, F.desc("score"), F.asc("vec_id"))
    return top_per_group(pool, ["query", "polarity"], 3, F.desc("score"), F.asc("vec_id"))


@query("q016_profile_blocks", """
with b as (select doc_id, unnest(range(1, len(p) + 1)) i, p from (select doc_id, list_filter(list_transform(string_split(chr(10) || '## ' || replace(text, chr(10), chr(10) || '## '), chr(10) || '## '), lambda x: trim(x)), lambda x: length(x) > 30) p from documents))
select doc_id, i as block, p[i] as body, sha256(p[i]) as digest from b""")
def q016(t: Tables) -> DataFrame:
    md = t.documents.select("doc_id", F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("md"))
    each = md.select("doc_id", F.posexplode(heading_blocks("md", 30)).alias("i", "body"))
    return each.select("doc_id", (F.col("i") + 1).cast("long").alias("block"), "body", F.sha2("body", 256).alias("digest"))


@query("q017_document_store", """
with saved as (select conv_id, max(turn) as updated_at from conversations where conv_id % 3 <> 0 group by conv_id), sessions as (select conv_id, max(turn) as updated_at from conversations group by conv_id)
select conv_id, updated_at, 'record' as origin from saved union all select conv_id, updated_at, 'session' from sessions where conv_id not in (select conv_id from saved)""")
def q017(t: Tables) -> DataFrame:
    """Saved records, and ids known from sessions only."""
    sessions = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("updated_at"))
    saved = sessions.where("conv_id % 3 <> 0")
    only = ops.delete_where(sessions, saved.select("conv_id"), "conv_id")
    return saved.withColumn("origin", F.lit("record")).unionByName(only.withColumn("origin", F.lit("session")))


@query("q018_fan_out_merge", r"""
with u as (select page_id, url, 1 as provider from pages where page_id % 2 = 0 union all select page_id + 1000000, case when page_id % 3 = 0 then url || '/' else url end, 2 from pages where page_id % 3 <> 1),
r as (select *, row_number() over (partition by regexp_replace(lower(trim(url)), '/+$', '') order by provider, page_id) rn from u)
select page_id, provider from r where rn = 1""")
def q018(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", "url")
    second = p.where("page_id % 3 <> 1").select((F.col("page_id") + 1000000).alias("page_id"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/"))).otherwise(F.col("url")).alias("url"), F.lit(2).alias("provider"))
    merged = p.where("page_id % 2 = 0").withColumn("provider", F.lit(1)).unionByName(second)
    return ops.first_wins(merged, strip_slash("url"), "provider", "page_id").select("page_id", "provider")


@query("q023_backfill_copy", "select vec_id, label, len(embedding)::bigint as dim, round(list_sum(embedding::double[]), 6) as total, round(list_max(embedding)::double, 6) as largest from embeddings")
def q023(t: Tables) -> DataFrame:
    """Copy a table from one format to another with ids and vectors unchanged."""
    from tidewell.sources.copying import copy_table

    copied = copy_table(t.embeddings, scratch(t.spark, "copy"), "orc")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return copied.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.round(total, 6).alias("total"), F.round(F.array_max("embedding").cast("double"), 6).alias("largest"))


@query("q021_folder_corpus")
def q021(t: Tables) -> DataFrame:
    """Files of a folder, as of a checked-out repository: this package's own."""
    from pathlib import Path

    from tidewell.sources.folder import read_files

    own = t.spark.createDataFrame([(str(p), p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).parent.glob("*.py"))], "path string, content string")
    folder = scratch(t.spark, "folder")
    own.select(F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("module"), F.col("content").alias("value")).write.partitionBy("module").option("lineSep", "\n").text(folder)
    return read_files(t.spark, folder).select(F.regexp_extract("path", r"module=([^/]+)/", 1).alias("module"), "size", F.sha2("content", 256).alias("digest"))


@query("q022_job_log_source", "select user_id::varchar as job_id, event_id as seq, event_type as event from events where user_id in (1, 3, 5, 8) and event_id >= 40")
def q022_source(t: Tables) -> DataFrame:
    """A log of all events read through its own data source, with filters that reach the reader."""
    from tidewell.sources.job_log import register
    from tidewell.sources.job_stream import append_events

    path = scratch(t.spark, "log")
    append_events(t.events.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event")), path)
    register(t.spark)
    log = t.spark.read.format("job_log").load(path)
    return log.where(F.col("job_id").isin("1", "3", "5", "8") & (F.col("seq") >= 40)).select("job_id", "seq", "event")
