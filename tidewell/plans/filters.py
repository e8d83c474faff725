"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import scores, texts, urls
from tidewell.operators import ranking as rank
from tidewell.operators import tables as ops
from tidewell.plans.registry import Tables, query
from tidewell.plans.scans import HOST_SQL


@query("q024_payload_predicates", "select event_id, event_type from events where (props->>'$.k')::int in (3, 5, 7) and event_type not in ('view', 'click') and user_id <> 4")
def q024(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.where(k.isin(3, 5, 7) & ~F.col("event_type").isin("view", "click") & (F.col("user_id") != 4)).select("event_id", "event_type")


@query("q024_typed_payload", """
with p as (select event_id, case event_id % 5 when 0 then '{"k": null}' when 1 then '{"t": "x"}' when 2 then '{"k": "' || (props->>'$.k') || '"}' else props end as raw, event_id % 7 = 0 as bad from events)
select event_id, (raw->>'$.k') in ('3', '5', '7') as held, (raw->>'$.k') not in ('3', '5', '7') as other, json_type(raw, '$.k') in ('UBIGINT', 'BIGINT', 'DOUBLE') and (raw->>'$.k')::int >= 10 and (raw->>'$.k')::int < 60 as number from p where not bad and (raw->>'$.k') is not null""")
def q024_typed(t: Tables) -> DataFrame:
    """Typed payloads: rows whose key is missing or null pass neither IN nor NOT IN, texts that don't parse are dropped."""
    from tidewell.functions import payload

    i = F.col("event_id")
    raw = F.when(i % 7 == 0, "{broken").when(i % 5 == 0, '{"k": null}').when(i % 5 == 1, '{"t": "x"}').when(i % 5 == 2, F.concat(F.lit('{"k": "'), F.get_json_object("props", "$.k"), F.lit('"}'))).otherwise(F.col("props"))
    p = t.events.select("event_id", payload.parsed(raw).alias("p"))
    held, other = payload.among("p", "k", ["3", "5", "7"]), payload.not_among("p", "k", ["3", "5", "7"])
    return p.where(held | other).select("event_id", held.alias("held"), other.alias("other"), payload.number_in("p", "k", 10, 60).alias("number"))


@query("q025_allow_list", "select 'none' as list, count(*) as n from documents union all select 'some', count(*) from documents where doc_id in (1, 2, 3) union all select 'empty', 0")
def q025(t: Tables) -> DataFrame:
    """No list means no filter; a list of blanks only means no rows."""

    def allowed(name: str, ids: list[int] | None) -> DataFrame:
        rows = t.documents if ids is None else t.documents.where(F.col("doc_id").isin(ids)) if ids else t.documents.limit(0)
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("list"), "n")

    return allowed("none", None).union(allowed("some", [1, 2, 3])).union(allowed("empty", []))


@query("q026_exclude_ids", "with a as (select doc_id, [doc_id::varchar || '_1', (doc_id // 2)::varchar || '_2'] as chunks from documents) select doc_id from a where doc_id % 7 <> 0 and not list_has_any(chunks, ['3_1', '10_2', '12_2', '40_1'])")
def q026(t: Tables) -> DataFrame:
    chunks = F.array(F.concat("doc_id", F.lit("_1")), F.concat(F.floor(F.col("doc_id") / 2), F.lit("_2")))
    gone = F.array(*[F.lit(x) for x in ("3_1", "10_2", "12_2", "40_1")])
    return ops.delete_where(t.documents.withColumn("chunks", chunks), t.documents.where("doc_id % 7 = 0").select("doc_id"), "doc_id").where(~F.arrays_overlap("chunks", gone)).select("doc_id")


@query("q027_score_floor", "select event_id, value from events where value >= greatest(0.0, 40.0)")
def q027(t: Tables) -> DataFrame:
    return t.events.where(F.col("value") >= max(0.0, 40.0)).select("event_id", "value")


@query("q028_document_gate", """
with q as (select vec_id as query, embedding::double[] v from embeddings where vec_id % 50 = 0), s as (select query, vec_id, case when vec_id % 9 = 0 then null else list_cosine_similarity(embedding::double[], v) end c from embeddings, q)
select query, vec_id from s where c is null or round(c, 6) >= 0.1""")
def q028(t: Tables) -> DataFrame:
    """Chunks whose document is near enough; a missing document vector passes."""
    from tidewell.plans.search import pairs_of

    docs = t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")))
    return pairs_of(t, docs.select("vec_id", "embedding"), floor=0.1, score=False).select("query", "vec_id")


TRUST_SQL = "with e as (select event_id, value / 50.0 as sim, case when (props->>'$.k')::int % 10 = 0 then null else (props->>'$.k')::int / 100.0 end as trust from events)"


def trust_rows(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", (F.col("value") / 50.0).alias("sim"), F.when(k % 10 != 0, k / 100.0).alias("trust"))


@query("q029_trust_cutoff", TRUST_SQL + " select event_id from e where least(1.0, greatest(0.0, coalesce(trust, 1.0))) >= 0.2 or sim >= 0.85")
def q029(t: Tables) -> DataFrame:
    return trust_rows(t).where(scores.passes_trust("sim", "trust")).select("event_id")


@query("q030_relaxation_gate", TRUST_SQL + """, h as (select event_id, event_id // 200 as query, coalesce(trust, 1.0) as trust, event_id % 12 as cites from e), g as (select *, case when trust >= 0.95 and cites >= 11 then 0 when trust >= 0.9 and cites >= 4 then 1 else 2 end as lvl from h),
n as (select query, case when count(*) filter (where lvl = 0) >= 3 then 0 when count(*) filter (where lvl <= 1) >= 3 then 1 else 2 end as chosen from g group by query)
select g.query, chosen::bigint as chosen, count(*) as hits from g join n using (query) where lvl <= chosen group by all""")
def q030(t: Tables) -> DataFrame:
    """The strictest level that leaves three hits to a query."""
    hits = trust_rows(t).select(F.floor(F.col("event_id") / 200).alias("query"), F.coalesce("trust", F.lit(1.0)).alias("trust"), (F.col("event_id") % 12).alias("cites"))
    relaxed = scores.relax(hits, ["query"], [(F.col("trust") >= 0.95) & (F.col("cites") >= 11), (F.col("trust") >= 0.9) & (F.col("cites") >= 4)], least=3)
    return relaxed.groupBy("query", "chosen").agg(F.count(F.lit(1)).alias("hits"))


PAGE_KIND = "case page_id % 6 when 0 then replace(url, 'example', 'youtube') when 1 then replace(url, 'example.org', 'arxiv.org') when 2 then replace(url, 'example.com', 'habr.com') else url end"


def varied(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.expr(PAGE_KIND).alias("url"))


@query("q031_url_rank_and_cap", f"""
with u as (select distinct {PAGE_KIND} as url from pages), s as (select url, case when contains(lower(url), 'arxiv.org') then 0 when contains(lower(url), 'doi.org') then 1 when contains(lower(url), 'semanticscholar.org') then 2 when contains(lower(url), 'habr.com') then 3 when contains(lower(url), 'peerj.com') then 4 when contains(lower(url), 'crossref') then 5 else 7 end as priority from u where not regexp_matches(lower(url), 'youtube\\.com|youtu\\.be|microsoft\\.com|geeksforgeeks\\.org|wikipedia\\.org'))
select url, priority from s order by priority, url limit 60""")
def q031(t: Tables) -> DataFrame:
    u = varied(t).select("url").distinct().where(~urls.is_blocked("url"))
    return u.withColumn("priority", urls.priority("url")).orderBy("priority", "url").limit(60)


@query("q032_collectible_urls", f"""
with u as (select page_id, case when page_id % 5 = 0 then regexp_extract({PAGE_KIND}, '^[a-z]+://[^/]+', 0) || '/' when page_id % 5 = 1 then 'ftp' || {PAGE_KIND} else {PAGE_KIND} end as url from pages)
select page_id from u where starts_with(url, 'http') and not regexp_matches(lower(url), 'youtube\\.com|youtu\\.be|microsoft\\.com|geeksforgeeks\\.org|wikipedia\\.org') and contains(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.') and page_id % 5 <> 0""")
def q032(t: Tables) -> DataFrame:
    bare = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), F.lit("/"))
    u = varied(t).withColumn("url", F.when(F.col("page_id") % 5 == 0, bare).when(F.col("page_id") % 5 == 1, F.concat(F.lit("ftp"), "url")).otherwise(F.col("url")))
    return u.where(urls.is_collectible("url")).select("page_id")


@query("q033_academic_bucket", f"""
with u as (select page_id, {PAGE_KIND} as url, case page_id % 8 when 3 then 'OpenAlex' when 5 then 'consensus_x' else 'exa' end as tier from pages)
select page_id, case when lower(tier) in ('openalex', 'arxiv') or starts_with(lower(tier), 'consensus') or regexp_matches({HOST_SQL}, '(^|\\.)(arxiv|semanticscholar|aclanthology|doi|openreview)\\.(org|net)$') or contains(lower(url), 'arxiv.org') then 'academic' else 'practical' end as bucket from u""")
def q033(t: Tables) -> DataFrame:
    tier = F.expr("CASE page_id % 8 WHEN 3 THEN 'OpenAlex' WHEN 5 THEN 'consensus_x' ELSE 'exa' END")
    return varied(t).select("page_id", urls.bucket(F.col("url"), tier).alias("bucket"))


PATTERNS = [("example.org", "docs", 0), ("example.com/en", "guides", 1), ("example.net", "news", 2), ("blog.thther.example.com/fr", "blog", 3)]
PATTERN_SQL = "(values " + ", ".join(f"('{p}', '{c}', {i})" for p, c, i in PATTERNS) + ") w(pattern, category, i)"
MATCH_SQL = "(host = pattern or host_path = pattern or starts_with(host_path, pattern) or starts_with(pattern, host_path) or host = split_part(pattern, '/', 1) or ends_with(host, '.' || split_part(pattern, '/', 1)))"


@query("q034_whitelist_match", rf"""
with u as (select page_id, {HOST_SQL} as host, {HOST_SQL} || case when trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') = '' then '' else '/' || trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') end as host_path from pages)
select page_id, arg_min(category, i) as category from u, {PATTERN_SQL} where {MATCH_SQL} group by page_id""")
def q034(t: Tables) -> DataFrame:
    patterns = t.spark.createDataFrame(PATTERNS, "pattern string, category string, i int")
    return scores.match_whitelist(t.pages, patterns)


@query("q035_provenance", rf"""
with u as (select page_id, url, {HOST_SQL} as host, {HOST_SQL} || case when trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') = '' then '' else '/' || trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') end as host_path from (select page_id, {PAGE_KIND} as url from pages)),
m as (select page_id, arg_min(category, i) as category from u, {PATTERN_SQL} where {MATCH_SQL} group by page_id),
a as (select page_id, (page_id % 10) / 10.0 as trust from pages where page_id % 2 = 0)
select u.page_id, case when regexp_matches(host, '(^|\.)(arxiv|semanticscholar|aclanthology|doi|openreview)\.(org|net)$') then 'academic_open' when category is not null then category when coalesce(trust, 0) >= 0.72 then 'archive_trusted' else 'open_candidate' end as provenance from u left join m using (page_id) left join a using (page_id)""")
def q035(t: Tables) -> DataFrame:
    u = varied(t)
    patterns = t.spark.createDataFrame(PATTERNS, "pattern string, category string, i int")
    trust = t.pages.where("page_id % 2 = 0").select("page_id", ((F.col("page_id") % 10) / 10.0).alias("trust"))
    found = u.join(scores.match_whitelist(u, patterns), "page_id", "left").join(trust, "page_id", "left")
    kind = F.when(urls.is_academic("url"), "academic_open").when(F.col("category").isNotNull(), F.col("category")).when(F.coalesce("trust", F.lit(0.0)) >= 0.72, "archive_trusted").otherwise("open_candidate")
    return found.select("page_id", kind.alias("provenance"))


@query("q036_challenge_pages", """
with p as (select page_id, case page_id % 9 when 2 then 'Just a Moment... ' || html when 4 then html || 'captcha' else html end as html, case page_id % 11 when 3 then 403 else 200 end as status from pages)
select page_id from p where regexp_matches(lower(substr(html, 1, 8000)), 'just a moment|cloudflare|cf-browser-verification|checking your browser|verifying your browser|enable javascript|access denied|captcha|bot detection|please turn javascript on|robot check') or status in (401, 403, 429, 503)""")
def q036(t: Tables) -> DataFrame:
    html = F.when(F.col("page_id") % 9 == 2, F.concat(F.lit("Just a Moment... "), "html")).when(F.col("page_id") % 9 == 4, F.concat("html", F.lit("captcha"))).otherwise(F.col("html"))
    status = F.when(F.col("page_id") % 11 == 3, 403).otherwise(200)
    return t.pages.where(texts.is_challenge(html, status)).select("page_id")


@query("q037_noise_paragraphs", r"""
with p as (select doc_id, unnest(list_concat(string_split(text, chr(10)), ['12', 'a', 'QPS (log)', 'IEEE 2021 page', '3.5 %', 'Permission to make digital or hard copies'])) as line from documents)
select doc_id, count(*) as lines, count(*) filter (where length(trim(line)) < 2 or regexp_matches(trim(line), '(?i)permission\s+to\s+make\s+digital\s+or\s+hard\s+copies') or regexp_matches(trim(line), '^\d{1,3}$') or (length(trim(line)) <= 120 and regexp_matches(trim(line), '(?i)(ASPLOS|IEEE|ACM|Proceedings)\s*[’'']?\s*\d{2,4}') and length(trim(line)) - length(replace(trim(line), '.', '')) <= 2) or (length(trim(line)) <= 48 and regexp_matches(trim(line), '(?i)^(\d+\s*|(queries/sec|qps|latency|throughput|log\s+scale|linear\s+scale)(\s*\([^)]{0,40}\))?|\d+(\.\d+)?\s*%|[0-9]+(\.[0-9]+)?)$'))) as noise from p group by doc_id""")
def q037(t: Tables) -> DataFrame:
    extra = F.array(*[F.lit(x) for x in ("12", "a", "QPS (log)", "IEEE 2021 page", "3.5 %", "Permission to make digital or hard copies")])
    lines = t.documents.select("doc_id", F.explode(F.concat(F.split("text", "\n"), extra)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(texts.is_noise("line")).alias("noise"))


@query("q038_length_filters", "select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 24))::bigint as chunks from documents where length(trim(text)) >= 40")
def q038(t: Tables) -> DataFrame:
    return t.documents.where(F.length(F.trim("text")) >= 40).select("doc_id", F.size(texts.blocks_of("text", "\n", 24)).cast("long").alias("chunks"))


@query("q039_back_matter", """
with l as (select doc_id, i, x from (select doc_id, unnest(range(len(p))) as i, p from (select doc_id, string_split(case when doc_id % 3 = 0 then text || chr(10) || 'References' || chr(10) || text else text end, chr(10)) p from documents)), lateral (select p[i + 1] as x)),
c as (select doc_id, min(i) as cut from l where regexp_matches(trim(x), '(?i)^(references|bibliography|appendix)') group by doc_id)
select doc_id, count(*) as kept from l left join c using (doc_id) where cut is null or i < cut group by doc_id""")
def q039(t: Tables) -> DataFrame:
    """Paragraphs before the first section of references or appendices."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("\n", "text", F.lit("References"), "text")).otherwise(F.col("text"))
    parts = F.split(text, "\n")
    cut = F.array_position(F.transform(parts, lambda x: F.trim(x).rlike("(?i)^(references|bibliography|appendix)")), True)
    return t.documents.select("doc_id", F.when(cut > 0, cut - 1).otherwise(F.size(parts)).cast("long").alias("kept")).where("kept > 0")


@query("q040_structure_filter", """
with p as (select d.doc_id, d.doc_id // 100 as article, d.doc_id % 100 as par, l.quality, l.toxic from documents d left join labels l using (doc_id))
select doc_id, article, row_number() over (partition by article order by case when toxic = 1 then 0 else 1 end, coalesce(-quality, 5), doc_id) as place from p where (quality is null or quality = 1) and par not between 50 and 60""")
def q040(t: Tables) -> DataFrame:
    """Paragraphs of each article outside its references and not dropped, core ones first; unlabelled ones stay, last of their class."""
    from pyspark.sql import Window

    p = t.documents.select("doc_id", F.floor(F.col("doc_id") / 100).alias("article")).join(t.labels, "doc_id", "left")
    p = p.where((F.col("quality").isNull() | (F.col("quality") == 1)) & ~(F.col("doc_id") % 100).between(50, 60))
    order = Window.partitionBy("article").orderBy(F.when(F.col("toxic") == 1, 0).otherwise(1), F.coalesce(-F.col("quality"), F.lit(5)), "doc_id")
    return p.select("doc_id", "article", F.row_number().over(order).cast("long").alias("place"))


@query("q041_over_pruning", r"""
with w as (select doc_id, len(regexp_extract_all(text, '[^ \t-\r]+'))::bigint raw from documents), f as (select doc_id, raw, case when doc_id % 2 = 0 then raw // 3 else raw - 10 end as filtered from w)
select doc_id, raw >= 800 and filtered < raw and (filtered < 400 or filtered < 0.35 * raw) as stub from f""")
def q041(t: Tables) -> DataFrame:
    raw = F.size(F.filter(F.split("text", r"[ \t-\r]+"), lambda x: x != "")).cast("long")
    f = t.documents.select("doc_id", raw.alias("raw")).withColumn("filtered", F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("raw") / 3)).otherwise(F.col("raw") - 10))
    return f.select("doc_id", scores.discards_source("raw", "filtered").alias("stub"))


@query("q042_domain_trust", f"""
with h as (select page_id, {HOST_SQL} as host from pages), v as (select distinct host, ascii(substr(host, 1, 1)) % 3 = 0 as reject from h where ascii(substr(host, 1, 1)) % 5 <> 0)
select page_id, host from h left join v using (host) where reject is null or not reject""")
def q042(t: Tables) -> DataFrame:
    """URLs of domains that weren't rejected; a domain without verdict passes."""
    h = t.pages.select("page_id", urls.host("url").alias("host"))
    first = F.ascii(F.substring("host", 1, 1))
    verdicts = h.where(first % 5 != 0).select("host", (first % 3 == 0).alias("reject")).distinct()
    return h.join(verdicts, "host", "left").where(~F.coalesce("reject", F.lit(False))).select("page_id", "host")


@query("q043_practical_filters", rf"""
with u as (select page_id, case page_id % 4 when 0 then url || '/api/x' else {PAGE_KIND} end as url from pages)
select page_id, case when not starts_with(url, 'http') then 'not_http' when page_id % 4 = 0 and page_id % 3 = 0 then null when contains(lower(url), '/docs/') then 'practical_api_doc_path:/docs/' when contains(lower(url), '/api/') then 'practical_api_doc_path:/api/' when regexp_matches({HOST_SQL}, '(^|\.)arxiv\.org$') then 'practical_blocked_host:arxiv.org' end as reason from u""")
def q043(t: Tables) -> DataFrame:
    u = varied(t).join(t.pages.withColumnRenamed("url", "raw").select("page_id", "raw"), "page_id")
    url = F.when(F.col("page_id") % 12 == 0, "https://www.Official.dev/docs/api/x").when(F.col("page_id") % 4 == 0, F.concat("raw", F.lit("/api/x"))).otherwise(F.col("url"))
    return u.select("page_id", urls.practical_reject(url, official=["official.dev"]).alias("reason"))


@query("q043_registry_filter", r"""
with u as (select page_id, case page_id % 8 when 0 then 'https://example.com/' || page_id::varchar when 1 then replace(url, 'http', 'ftp') when 2 then 'http://x' when 3 then 'HTTPS://a.B.test/' || page_id::varchar when 4 then 'http://' when 5 then 'http://user@localhost:80/' || page_id::varchar when 6 then ' ' || upper(url) || ' ' else url end as url from pages),
h as (select page_id, trim(url) as url, lower(regexp_extract(trim(url), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as site from u)
select page_id, url from h where length(url) >= 8 and site <> '' and site not in ('example.com', 'example.org', 'example.net', 'example.edu', 'localhost', '127.0.0.1', '0.0.0.0') and not regexp_matches(site, '\.(example|invalid|test)$')""")
def q043_registry(t: Tables) -> DataFrame:
    """Registry entries without addresses that are reserved for examples."""
    p = F.col("page_id")
    url = F.expr("CASE page_id % 8 WHEN 0 THEN 'https://example.com/' || page_id WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN 'http://x' WHEN 3 THEN 'HTTPS://a.B.test/' || page_id WHEN 4 THEN 'http://' WHEN 5 THEN 'http://user@localhost:80/' || page_id WHEN 6 THEN ' ' || upper(url) || ' ' ELSE url END")
    return t.pages.select(p, F.trim(url).alias("url")).where(~urls.is_placeholder("url"))


SNIPPET_SQL = "case turn % 8 when 0 then 'def f(x):' || chr(10) || '    return x' when 1 then '```' || chr(10) || text || chr(10) || '```' when 2 then 'Deep Dive: return of ' || text when 3 then 'x = g(' || conv_id::varchar || '); y = h(1)' when 4 then 'a' when 5 then replace(text, '. ', ' && ') when 6 then '  ' || text || '  ' else 'while (' || conv_id::varchar || ') go' end"


@query("q043_code_snippets", rf"""
with s as (select conv_id, turn, trim({SNIPPET_SQL}, ' ' || chr(10)) as raw from conversations),
l as (select *, list_filter(string_split(raw, chr(10)), lambda x: trim(x) <> '') as lines from s),
c as (select *, length(raw) >= 4 and not regexp_matches(raw, '(?i)^deep\s*dive\s*:') and (regexp_matches(raw, '(?m)^```') or regexp_matches(raw, '(?i)(^|[^\p{{L}}\p{{N}}_])(def|class|import|from|return|elif|else|async|await|function|const|let|var|interface|struct|enum|namespace|select|insert|update|delete|create|with|public|private|protected|static|void|int|float|bool)([^\p{{L}}\p{{N}}_]|$)') or regexp_matches(raw, '(?im)^\s*(if|for|while|switch|case|try|catch)\s*[\(:]') or (len(lines) >= 2 and len(list_filter(lines, lambda x: starts_with(x, '    ') or starts_with(trim(x), '#') or starts_with(trim(x), '//') or contains(x, ';') or contains(x, '{{') or contains(x, '}}'))) > 0) or (contains(raw, ';') and (contains(raw, '=') or contains(raw, '('))) or (len(string_split(raw, '(')) >= 3 and len(string_split(raw, ')')) >= 3 and contains(raw, '=')) or regexp_matches(raw, '=>|::|\+\+|--|\|\||&&')) as code from l)
select conv_id, min(turn) as turn, raw as snippet from c where code group by conv_id, raw""")
def q043_snippets(t: Tables) -> DataFrame:
    """Snippets of a conversation that are code, each once."""
    from tidewell.functions.code import is_likely_code

    made = F.expr("CASE turn % 8 WHEN 0 THEN 'def f(x):\n    return x' WHEN 1 THEN '```\n' || text || '\n```' WHEN 2 THEN 'Deep Dive: return of ' || text WHEN 3 THEN 'x = g(' || conv_id || '); y = h(1)' WHEN 4 THEN 'a' WHEN 5 THEN replace(text, '. ', ' && ') WHEN 6 THEN '  ' || text || '  ' ELSE 'while (' || conv_id || ') go' END")
    s = t.conversations.select("conv_id", "turn", F.regexp_replace(made, r"^\s+|\s+$", "").alias("snippet")).where(is_likely_code("snippet"))
    return s.groupBy("conv_id", "snippet").agg(F.min("turn").alias("turn"))


@query("q044_anchor_cut", """
with a as (select vec_id as query, embedding::double[] v from embeddings where vec_id % 50 = 0), s as (select query, vec_id, (round(list_cosine_similarity(embedding::double[], v), 6) + 1) / 2 as score from embeddings, a)
select query, vec_id, round(score, 7) as core, round(0.7 * score + 0.3 * coalesce(case when vec_id % 4 = 0 then null else 0.5 end, score), 9) as mixed from s where score >= 0.55""")
def q044(t: Tables) -> DataFrame:
    """Atoms near each anchor, with the mix of query and core score."""
    from tidewell.plans.search import pairs_of

    s = pairs_of(t, t.embeddings.select("vec_id", "embedding"), floor=0.0999).select("query", "vec_id", ((F.col("score") + 1) / 2).alias("score")).where("score >= 0.55")
    core = F.when(F.col("vec_id") % 4 != 0, 0.5)
    # the scores have seven digits and the mix nine at most, so the nearest whole number is what rounding half up finds
    digits = lambda x, n: F.rint(x * 10.0**n) / 10.0**n
    return s.select("query", "vec_id", digits(F.col("score"), 7).alias("core"), digits(0.7 * F.col("score") + 0.3 * F.coalesce(core, F.col("score")), 9).alias("mixed"))


@query("q045_scope_preference", """
with a as (select turn, conv_id, case turn % 5 when 0 then 'CONCEPT' when 1 then 'PRACTICE' when 2 then 'MECHANIC' when 3 then 'EDGE_CASE' else 'ANTI_PATTERN' end as scope from conversations),
r as (select *, row_number() over (partition by conv_id order by case when scope in ('PRACTICE', 'EDGE_CASE') then 1 else 0 end, turn) rn from a where conv_id % 2 = 0 or scope not in ('PRACTICE', 'EDGE_CASE'))
select conv_id, turn, scope from r where rn <= 4""")
def q045(t: Tables) -> DataFrame:
    """Ideas first; instances only on code intent, after them."""
    scope = F.expr("CASE turn % 5 WHEN 0 THEN 'CONCEPT' WHEN 1 THEN 'PRACTICE' WHEN 2 THEN 'MECHANIC' WHEN 3 THEN 'EDGE_CASE' ELSE 'ANTI_PATTERN' END")
    a = t.conversations.select("conv_id", "turn", scope.alias("scope"))
    instance = F.col("scope").isin("PRACTICE", "EDGE_CASE")
    return rank.top_per_group(a.where((F.col("conv_id") % 2 == 0) | ~instance), ["conv_id"], 4, instance.cast("int"), F.col("turn"))


@query("q046_seen_split", "with k as (select distinct lower(trim(text)) key from documents where doc_id % 10 = 0) select doc_id, lower(trim(text)) in (select key from k) as seen from documents")
def q046(t: Tables) -> DataFrame:
    keyed = t.documents.select("doc_id", F.lower(F.trim("text")).alias("key"))
    seen = keyed.where("doc_id % 10 = 0").select("key").distinct().withColumn("seen", F.lit(True))
    return keyed.join(seen, "key", "left").select("doc_id", F.coalesce("seen", F.lit(False)).alias("seen"))


PICTURE_SQL = "with h as (select vec_id, xor(('0x' || substr(md5((vec_id // 4)::varchar), 1, 15))::bigint, case when vec_id % 4 = 0 then 0 else 1::bigint << (5 * (vec_id % 4)::int) end) as h from embeddings)"


@query("q047_image_hash_filter", PICTURE_SQL + " select a.vec_id as a, b.vec_id as b, bit_count(xor(a.h, b.h))::bigint as distance from h a join h b on a.vec_id < b.vec_id and bit_count(xor(a.h, b.h)) <= 3")
def q047(t: Tables) -> DataFrame:
    """Pairs of picture hashes within a few bits, blocked by equal bands so that no pair is lost."""
    from tidewell.operators.dedup import hamming_pairs

    v = F.col("vec_id")
    base = F.conv(F.substring(F.md5(F.floor(v / 4).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    h = t.embeddings.select("vec_id", base.bitwiseXOR(F.when(v % 4 == 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, cast(5 * (vec_id % 4) AS int))"))).alias("h"))
    return hamming_pairs(h, "vec_id", "h", bits=60, most=3)


@query("q047_accepted_pictures", """
with recursive p as (select vec_id as i, vec_id % 6 as doc, 100 + vec_id % 300 as width, 100 + (vec_id * 7) % 400 as height, case when vec_id % 11 = 0 then null else 1000 end as page, (vec_id * 13) % 1000 as top, (vec_id * 13) % 1000 + 60 as bottom, ((vec_id // 24) * 2654435761) % 4294967296 as base from embeddings),
f as (select i, doc, xor(base, case when i % 4 = 0 then 0 else (1::bigint << ((5 * i) % 29)) + (1::bigint << ((3 * i) % 29)) end) as h from p where width >= 150 and height >= 150 and width::double / height <= 4 and width::double / height >= 0.25 and (page is null or (top / 1000.0 >= 0.08 and bottom / 1000.0 <= 0.92))),
o as (select *, row_number() over (partition by doc order by i) as r from f),
a(doc, r, kept, hs) as (select doc, 1, [i], [h] from o where r = 1 union all select o.doc, o.r, case when x then list_append(kept, i) else kept end, case when x then list_append(hs, h) else hs end from (select a.doc, a.kept, a.hs, o.i, o.h, o.r, len(list_filter(a.hs, lambda y: bit_count(xor(y, o.h)) <= 4)) = 0 as x from a join o on o.doc = a.doc and o.r = a.r + 1) o)
select doc, unnest(kept) as i from a where (doc, r) in (select doc, max(r) from o group by doc)""")
def q047_accepted(t: Tables) -> DataFrame:
    """Pictures of six documents in order: size, shape and place, then unlike those kept before."""
    from tidewell.operators.pictures import accepted

    v = F.col("vec_id")
    base = F.pmod(F.floor(v / 24) * 2654435761, F.lit(4294967296))
    noise = F.when(v % 4 == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, cast((5 * vec_id) % 29 AS int)) + shiftleft(1L, cast((3 * vec_id) % 29 AS int))"))
    p = t.embeddings.select(v.alias("i"), (v % 6).alias("doc"), (100 + v % 300).alias("width"), (100 + (v * 7) % 400).alias("height"), F.when(v % 11 != 0, 1000).alias("page_height"), ((v * 13) % 1000).alias("top"), ((v * 13) % 1000 + 60).alias("bottom"), base.bitwiseXOR(noise).alias("h"))
    return accepted(p, ["doc"], "i", "h").select("doc", "i")
