"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import code, scores, texts, urls
from tidewell.functions.chunking import sliding_chunks, token_windows
from tidewell.functions.vectors import cosine
from tidewell.operators import tables as ops
from tidewell.operators.packing import next_fit
from tidewell.plans.filters import varied
from tidewell.plans.registry import Tables, query
from tidewell.plans.scans import HOST_SQL


@query("q137_sliding_chunks")
def q137(t: Tables) -> DataFrame:
    chunks = sliding_chunks(F.col("text"), F.lit(600), F.lit(100))
    return t.documents.select("doc_id", F.posexplode(chunks).alias("i", "chunk"))


@query("q138_extract_split", r"""
with b as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 40)[1:6] as p from documents), e as (select doc_id, unnest(range(1, len(p) + 1)) as i, p from b)
select doc_id, i as part, case when length(p[i]) <= 600 then p[i] else regexp_replace(left(p[i], 600), '\s+\S*$', '') || '…' end as extract from e""")
def q138(t: Tables) -> DataFrame:
    b = t.documents.select("doc_id", F.posexplode(F.slice(texts.blocks_of("text", "\n", 40), 1, 6)).alias("i", "x"))
    cut = F.concat(F.regexp_replace(F.substring("x", 1, 600), r"\s+\S*$", ""), F.lit("…"))
    return b.select("doc_id", (F.col("i") + 1).cast("long").alias("part"), F.when(F.length("x") <= 600, F.col("x")).otherwise(cut).alias("extract"))


@query("q139_section_chunks", "with s as (select doc_id, '## ' || replace(text, chr(10), chr(10) || '### ') as md from documents), p as (select doc_id, list_filter(list_transform(string_split(replace(md, chr(10) || '#', chr(10) || chr(1) || '#'), chr(10) || chr(1)), lambda x: trim(x)), lambda x: length(x) >= 40) as c from s), e as (select doc_id, unnest(range(1, len(c) + 1)) as i, c from p) select doc_id, i as section, c[i] as chunk from e")
def q139(t: Tables) -> DataFrame:
    md = F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n### ")))
    parts = F.filter(F.transform(F.split(md, r"\n(?=#{1,3}\s)"), lambda x: texts.trimmed(x)), lambda x: F.length(x) >= 40)
    return t.documents.select("doc_id", F.posexplode(parts).alias("i", "chunk")).select("doc_id", (F.col("i") + 1).cast("long").alias("section"), "chunk")


@query("q140_clean_text", r"with d as (select doc_id, 'Ab-' || chr(10) || 'cd ' || chr(13) || chr(10) || replace(text, '. ', ' ' || chr(10) || chr(10) || chr(10) || chr(10)) as t from documents) select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as body from d")
def q140(t: Tables) -> DataFrame:
    dirty = F.concat(F.lit("Ab-\ncd \r\n"), F.replace("text", F.lit(". "), F.lit(" \n\n\n\n")))
    return t.documents.select("doc_id", texts.clean(dirty).alias("body"))


@query("q141_paragraph_chunks", """
with recursive p as (select doc_id, i, length(x[i])::bigint as n from (select doc_id, string_split(text, chr(10)) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
b as (select doc_id, i, 0::bigint as bin, n as used from p where i = 1 union all select p.doc_id, p.i, case when b.used + p.n > 1200 then bin + 1 else bin end, case when b.used + p.n > 1200 then p.n else b.used + p.n end from b join p on p.doc_id = b.doc_id and p.i = b.i + 1)
select doc_id, bin, count(*) as paragraphs from b group by all""")
def q141(t: Tables) -> DataFrame:
    """Paragraphs packed while they fit."""
    p = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).select("doc_id", F.col("i").cast("long").alias("i"), F.length("x").cast("long").alias("n"))
    return next_fit(p, ["doc_id"], "i", "n", 1200).groupBy("doc_id", "bin").agg(F.count(F.lit(1)).alias("paragraphs"))


def annotated(text: str) -> F.Column:
    """Lines of a text as tagged paragraphs, each tenth with a figure after it."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    tag = lambda x, i: F.concat(F.lit("[P_"), i + 1, F.lit("] "), x, F.when((i + 1) % 10 == 0, F.concat(F.lit("\n[FIG_"), F.floor((i + 1) / 10), F.lit("] A drawing."))).otherwise(""))
    return F.array_join(F.transform(lines, tag), "\n")


@query("q142_token_windows")
def q142(t: Tables) -> DataFrame:
    """Whole blocks to the prompt's bound, under the article's header, with overlap of blocks."""
    d = t.documents.select("doc_id", annotated("text").alias("md"), F.concat(F.lit("# "), "source", F.lit(" "), "lang").alias("header"))
    w = d.select("doc_id", F.posexplode(token_windows(F.col("md"), F.col("header"))).alias("i", "w"))
    return w.select("doc_id", "i", "w.first", "w.last", "w.tokens", "w.paragraphs", "w.figures")


@query("q143_code_blocks", r"with b as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x)), lambda x: length(x) >= 1)) as b from documents), s as (select doc_id, case when length(b) <= 1200 then [b] else list_transform(range(0, (length(b) + 999) // 1000), lambda k: substr(b, (k * 1000 + 1)::int, 1000)) end as x from b) select doc_id, sum(len(x))::bigint as chunks, max(list_max(list_transform(x, lambda y: length(y))))::bigint as longest from s group by doc_id")
def q143(t: Tables) -> DataFrame:
    chunks = code.linear_chunks(F.replace("text", F.lit(". "), F.lit(".\n\n")), most=1200, piece=1000)
    c = t.documents.select("doc_id", chunks.alias("c")).where("size(c) > 0")
    return c.select("doc_id", F.size("c").cast("long").alias("chunks"), F.array_max(F.transform("c", F.length)).cast("long").alias("longest"))


@query("q143_long_blocks", r"with b as (select conv_id, string_agg(text, '' order by turn) as b from conversations group by conv_id), s as (select conv_id, case when length(b) <= 1200 then [b] else list_transform(range(0, (length(b) + 999) // 1000), lambda k: substr(b, (k * 1000 + 1)::int, 1000)) end as x from (select conv_id, trim(replace(b, chr(10), ' ')) as b from b)) select conv_id, unnest(range(1, len(x) + 1)) as part, unnest(list_transform(x, lambda y: md5(y))) as digest from s")
def q143_long(t: Tables) -> DataFrame:
    """Blocks without a blank line that are longer than a chunk: slices of a fixed size."""
    joined = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("b"))
    chunks = code.linear_chunks(F.replace("b", F.lit("\n"), F.lit(" ")), most=1200, piece=1000)
    return joined.select("conv_id", F.posexplode(chunks).alias("i", "c")).select("conv_id", (F.col("i") + 1).cast("long").alias("part"), F.md5(F.encode("c", "UTF-8")).alias("digest"))


@query("q144_strip_tags", r"select page_id, left(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')), 2000) as body from pages")
def q144(t: Tables) -> DataFrame:
    return t.pages.select("page_id", texts.strip_tags("html", 2000).alias("body"))


@query("q144_paragraphs")
def q144_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs of the main text by an HTML parser, in order."""
    from tidewell.functions.html import paragraphs

    return t.pages.select("page_id", F.posexplode(paragraphs(F.col("html"), F.lit(40))).alias("i", "paragraph"))


@query("q145_images", r"""
with h as (select page_id, html || '<figure><img alt="one" src="/pic/' || (page_id % 7)::varchar || '.png"></figure>' || case when page_id % 3 = 0 then '<img src="/b.png"><IMG src="/pic/' || (page_id % 7)::varchar || '.png">' else '' end || case when page_id % 5 = 0 then '<img alt="without">' else '' end as html from pages),
m as (select page_id, regexp_extract_all(html, '(?i)<img\b[^>]*>') as tags from h), s as (select page_id, unnest(range(len(tags))) as i, unnest(list_transform(tags, lambda x: regexp_extract(x, '(?i)\bsrc="([^"]*)"', 1))) as src from m),
f as (select page_id, src, min(i) as spot from s where src <> '' group by all) select page_id, row_number() over (partition by page_id order by spot) - 1 as i, src from f""")
def q145(t: Tables) -> DataFrame:
    """Sources of a page's images in order, each once; images without source don't count."""
    p = F.col("page_id")
    html = F.concat("html", F.lit('<figure><img alt="one" src="/pic/'), p % 7, F.lit('.png"></figure>'), F.when(p % 3 == 0, F.concat(F.lit('<img src="/b.png"><IMG src="/pic/'), p % 7, F.lit('.png">'))).otherwise(""), F.when(p % 5 == 0, F.lit('<img alt="without">')).otherwise(""))
    return t.pages.select("page_id", F.posexplode(texts.image_sources(html)).alias("i", "src")).select("page_id", F.col("i").cast("long").alias("i"), "src")


@query("q146_embedded_code", r"""
with h as (select page_id, html || '<pre>def f' || page_id::varchar || '():' || chr(10) || '  return <code>1</code></pre><p><code>x = f(' || page_id::varchar || ')</code></p>' as html from pages),
b as (select page_id, list_concat(regexp_extract_all(html, '(?is)<pre\b[^>]*>(.*?)</pre>', 1), regexp_extract_all(regexp_replace(html, '(?is)<pre\b[^>]*>.*?</pre>', ' ', 'g'), '(?is)<code\b[^>]*>(.*?)</code>', 1)) as b from h)
select page_id, unnest(range(len(b))) as i, unnest(b) as block from b""")
def q146(t: Tables) -> DataFrame:
    """Whole ``pre`` blocks, then ``code`` outside them."""
    html = F.concat("html", F.lit("<pre>def f"), "page_id", F.lit("():\n  return <code>1</code></pre><p><code>x = f("), "page_id", F.lit(")</code></p>"))
    return t.pages.select("page_id", F.posexplode(texts.code_blocks(html)).alias("i", "block")).select("page_id", F.col("i").cast("long").alias("i"), "block")


@query("q147_code_sources", f"with u as (select page_id, case page_id % 4 when 0 then 'https://github.com/a/b/' || page_id::varchar when 1 then url || '/x.py' else url end as url, case when page_id % 10 = 3 then 'github_tree' end as method from pages) select page_id from u where {HOST_SQL} in ('github.com') or regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '\\.(py|js|ts|go|rs|java|c|cpp|h|rb|sh|sql|ipynb)$') or method = 'github_tree'")
def q147(t: Tables) -> DataFrame:
    p = F.col("page_id")
    url = F.when(p % 4 == 0, F.concat(F.lit("https://github.com/a/b/"), p)).when(p % 4 == 1, F.concat("url", F.lit("/x.py"))).otherwise(F.col("url"))
    return t.pages.where(code.is_code_source(url, F.when(p % 10 == 3, F.lit("github_tree")))).select("page_id")


@query("q148_pdf_text", r"with d as (select doc_id, 'algo-' || chr(10) || ' rithm trans- form  Non- Linear ' || text as t from documents) select doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g'), '([\p{L}\p{N}_]{4,})-\s+(\p{Ll}[\p{L}\p{N}_]+)', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')), 4000) as body from d")
def q148(t: Tables) -> DataFrame:
    """Cleaned text up to the cleaner's own bound."""
    dirty = F.concat(F.lit("algo-\n rithm trans- form  Non- Linear "), "text")
    return t.documents.select("doc_id", F.substring(texts.squeeze(texts.merge_hyphens(dirty)), 1, 4000).alias("body"))


@query("q148_glued_words")
def q148_glued(t: Tables) -> DataFrame:
    """Documents whose first words lost their spaces, split by the word frequencies of all documents."""
    from tidewell.operators.segmentation import split_glued, word_counts

    head = F.substring_index("text", " ", 8)
    glued = t.documents.select("doc_id", F.concat(F.regexp_replace(head, "[^A-Za-z]", ""), F.lit(" "), F.col("text")).alias("body"))
    return split_glued(glued, "doc_id", "body", word_counts(t.documents, "text"))


@query("q149_sentence_heads", r"with s as (select doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s, case doc_id % 3 when 0 then 'all' when 1 then 'first' else 'first_two' end as mode, text from documents) select doc_id, len(s)::bigint as sentences, case mode when 'first' then coalesce(s[1], '') when 'first_two' then array_to_string(s[1:2], ' ') else trim(text) end as head from s")
def q149(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("text").alias("x"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'first' ELSE 'first_two' END").alias("mode"))
    return d.select("doc_id", F.size(texts.sentences("x")).cast("long").alias("sentences"), texts.extract("x", "mode").alias("head"))


@query("q150_sections", "with l as (select conv_id, turn, case when role = 'user' then text end as heading from conversations) select conv_id, turn, last_value(heading ignore nulls) over (partition by conv_id order by turn) as section from l")
def q150(t: Tables) -> DataFrame:
    """The last heading at or before each paragraph."""
    from pyspark.sql import Window

    l = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("heading"))
    return l.select("conv_id", "turn", F.last("heading", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn")).alias("section"))


@query("q150_headings", r"""
with t as (select page_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>') as tags from pages), e as (select page_id, unnest(range(len(tags))) as i, unnest(tags) as tag from t),
h as (select page_id, i, regexp_extract(tag, '(?i)<h([1-6])', 1)::int as level, trim(regexp_replace(regexp_replace(tag, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) as title from e) select page_id, i, level, title from h where length(title) >= 2""")
def q150_headings(t: Tables) -> DataFrame:
    """Headings of a page in order, of at least two characters."""
    h = t.pages.select("page_id", F.posexplode(texts.headings("html")).alias("i", "h")).select("page_id", F.col("i").cast("long").alias("i"), "h.level", "h.title")
    return h.where(F.length("title") >= 2)


@query("q150_heading_tree", r"""
with recursive t as (select page_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>') as tags from pages), e as (select page_id, unnest(range(len(tags))) as i, unnest(tags) as tag from t),
h as (select page_id, i, regexp_extract(tag, '(?i)<h([1-6])', 1)::int as level, trim(regexp_replace(regexp_replace(tag, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) as title from e), k as (select * from h where length(title) >= 2 union all select -1 - conv_id, turn, 1 + (conv_id + turn * turn) % 4, role from conversations),
p as (select *, (select max(b.i) from k b where b.page_id = k.page_id and b.i < k.i and b.level < k.level) as parent from k),
r(page_id, i, above, path) as (select page_id, i, parent, title from p union all select r.page_id, r.i, p.parent, p.title || ' > ' || r.path from r join p on p.page_id = r.page_id and p.i = r.above)
select p.page_id, p.i, level, title, parent, path from p join r using (page_id, i) where r.above is null""")
def q150_tree(t: Tables) -> DataFrame:
    """Each heading with the one it stands under and the titles from the root; turns of conversations count as headings of a document each."""
    from tidewell.operators.outline import heading_tree

    turns = t.conversations.select((-1 - F.col("conv_id")).alias("page_id"), F.col("turn").cast("long").alias("i"), (1 + (F.col("conv_id") + F.col("turn") * F.col("turn")) % 4).cast("int").alias("level"), F.col("role").alias("title"))
    h = q150_headings(t).unionByName(turns)
    return heading_tree(h, ["page_id"], "i", "level", "title").withColumn("path", F.array_join("path", " > "))


@query("q150_window_sections", r"""
with t as (select page_id, regexp_extract_all(html, '(?is)<(?:h[1-6]|p)\b[^>]*>.*?</(?:h[1-6]|p)>') as tags from pages), e as (select page_id, unnest(range(len(tags))) as p, unnest(tags) as tag from t),
x as (select page_id, p, regexp_matches(tag, '(?i)^<h[1-6]') as head, trim(regexp_replace(regexp_replace(tag, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) as body from e)
select page_id, p as first, (select arg_max(body, h.p) from x h where h.page_id = x.page_id and h.head and h.p <= x.p) as section from x where not head""")
def q150_window_sections(t: Tables) -> DataFrame:
    """The section of each paragraph: the last heading before it, its title matched to the paragraph that bears it."""
    from tidewell.operators.outline import match_paragraphs, sections_of

    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:h[1-6]|p)\b[^>]*>.*?</(?:h[1-6]|p)>"), F.lit(0))
    x = t.pages.select("page_id", F.posexplode(tags).alias("p", "tag")).select("page_id", F.col("p").cast("long").alias("p"), F.col("tag").rlike("(?i)^<h[1-6]").alias("head"), texts.strip_tags("tag").alias("body"))
    heads = x.where("head").select("page_id", "p", F.col("body").alias("title"))
    titled = match_paragraphs(heads.withColumn("h", F.concat_ws(" ", "p", "title")), x.where("head").withColumn("body", F.concat_ws(" ", "p", "body")), ["page_id"], "p", "h", "p", "body")
    return sections_of(x.where("NOT head").select("page_id", F.col("p").alias("first")), titled, ["page_id"], "first", "start", "title")


@query("q151_token_estimate", "with d as (select doc_id, case when doc_id % 4 = 0 then text || 'Привет мир' else text end as t from documents) select doc_id, floor(length(regexp_replace(t, '[^Ѐ-ӿ]', '', 'g')) / 1.75::double + (length(t) - length(regexp_replace(t, '[^Ѐ-ӿ]', '', 'g'))) / 3.7::double)::bigint as tokens from d")
def q151(t: Tables) -> DataFrame:
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("Привет мир"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", texts.estimated_tokens(text).alias("tokens"))


@query("q151_tokenizer_branch")
def q151_tokenizer(t: Tables) -> DataFrame:
    """Counts by a vocabulary file, where one is given."""
    import public_tokenizers

    from tidewell.functions.chunking import counted_tokens

    return t.conversations.select("conv_id", "turn", counted_tokens(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("tokens"))


@query("q152_host_and_id", rf"select page_id, {HOST_SQL} as host, substr(sha256(regexp_replace(lower(trim(url)), '/+$', '')), 1, 24) as doc from pages")
def q152(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.host("url").alias("host"), urls.document_id("url").alias("doc"))


@query("q153_urls_in_text", r"with d as (select page_id, 'see ' || url || ' and (' || url || ') or http://a.b/c, ok' as t from pages) select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, 'https?://[^\s<>\"'')\]]+'))), ' ') as found from d")
def q153(t: Tables) -> DataFrame:
    text = F.concat(F.lit("see "), "url", F.lit(" and ("), "url", F.lit(") or http://a.b/c, ok"))
    return t.pages.select("page_id", F.array_join(F.array_sort(texts.urls_in(text)), " ").alias("found"))


@query("q153_links_made_bold", r"with a as (select url from pages where page_id % 3 = 0), p as (select p.page_id, p.url, n.url as next from pages p left join pages n on n.page_id = p.page_id + 1) select page_id, 'see ' || case when contains(url, ')') then '[one](' || url || ')' when url in (select url from a) then '[one](' || url || ')' else '**one**' end || ', ' || case when next is null then '[two]()' when next in (select url from a) then '[two](' || next || ')' else '**two**' end as body from p")
def q153_links(t: Tables) -> DataFrame:
    """Markdown links that aren't on the list become bold text."""
    p = t.pages.select("page_id", "url")
    both = p.join(p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next")), "page_id", "left")
    text = both.select("page_id", F.concat(F.lit("see [one]("), "url", F.lit("), [two]("), F.coalesce("next", F.lit("")), F.lit(")")).alias("body"))
    allowed = p.where("page_id % 3 = 0").select("url")
    return ops.bold_links(text, "page_id", "body", allowed, "url").select("page_id", "body")


@query("q154_citations", "with d as (select doc_id, [1 + doc_id % 5, 1 + doc_id % 7] as cited from documents), x as (select doc_id, list_sort(list_distinct(list_filter(cited, lambda c: c not in (1, 2, 3)))) as bad from d) select doc_id, array_to_string(list_transform(bad, lambda c: 'A ' || c::varchar), ',') as unknown from x")
def q154(t: Tables) -> DataFrame:
    """Citations without a source, each once."""
    text = F.concat(F.lit("x [A "), 1 + F.col("doc_id") % 5, F.lit("] y [A "), 1 + F.col("doc_id") % 7, F.lit("]"))
    cited = F.regexp_extract_all(text, F.lit(r"\[(A \d+)\]"), F.lit(1))
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_except(cited, F.array(*[F.lit(f"A {i}") for i in (1, 2, 3)]))), ",").alias("unknown"))


@query("q155_search_query", """with p as (select p_partkey, string_split(p_name, ' ') as w, p_size from part) select p_partkey, '(' || array_to_string(list_transform(w, lambda x: 'ti:"' || x || '" OR abs:"' || x || '"'), ' OR ') || ') AND cat:cs.' || upper(left(w[1], 2)) || case when p_size > 20 then ' AND submittedDate:[' || (1990 + p_size)::varchar || '01010000 TO 203012312359]' else '' end || ' ANDNOT all:"survey"' as q from p""")
def q155(t: Tables) -> DataFrame:
    w = F.split("p_name", " ")
    terms = F.array_join(F.transform(w, lambda x: F.concat(F.lit('ti:"'), x, F.lit('" OR abs:"'), x, F.lit('"'))), " OR ")
    dates = F.when(F.col("p_size") > 20, F.concat(F.lit(" AND submittedDate:["), 1990 + F.col("p_size"), F.lit("01010000 TO 203012312359]"))).otherwise("")
    return t.part.select("p_partkey", F.concat(F.lit("("), terms, F.lit(") AND cat:cs."), F.upper(F.substring(w[0], 1, 2)), dates, F.lit(' ANDNOT all:"survey"')).alias("q"))


@query("q156_venue_trust", "with p as (select p_partkey, p_partkey % 90 as c, case p_partkey % 3 when 0 then 0.85 when 1 then 0.6 else 0.5 end as w from part) select p_partkey, round(round(w * (0.3 + 0.7 * least(1.0, ln(1 + c) / ln(41))), 3), 2)::double as trust from p")
def q156(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    return t.part.select("p_partkey", F.round(scores.venue_trust(p % 90, p % 3 == 0, p % 3 == 1), 2).alias("trust"))


@query("q157_citations_and_recency", "select p_partkey, round(least(1.0, ln(1 + p_partkey % 90) / ln(41)), 6) as cites, round(case when 1980 + p_size < 1990 or 1980 + p_size > 2026 then 0.5 else exp(-ln(2) * greatest(0, 2025 - (1980 + p_size)) / 5.0) end, 6) as recency from part")
def q157(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(scores.citation_share(F.col("p_partkey") % 90), 6).alias("cites"), F.round(scores.recency(1980 + F.col("p_size"), 2025), 6).alias("recency"))


@query("q158_cosine", "select a.vec_id, case when a.vec_id % 10 = 0 then 0.0 else round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) end as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def q158(t: Tables) -> DataFrame:
    """A zero vector has similarity 0."""
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    a = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 10 == 0, zero).otherwise(F.col("embedding").cast("array<double>")).alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine("x", "y"), 6).alias("score"))


TAGS = ("[SCOPE: mechanic] x", "edge-case", "Principle", "", "anti pattern", "[scope: METRIC]", "whatever", "EXAMPLES", "MECH", "errors", "EDGE_CASES", "CORNER CASES", "[scope: PRACTICE ] y", "Bad-practice!", "CAS", "algo rithm")
ALIAS_SQL = "(values " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(texts.SCOPE_ALIASES.items())) + ") a(i, alias, scope)"


@query("q159_scope_tags", rf"""
with v as (select p_partkey, [{", ".join(f"'{x}'" for x in TAGS)}][p_partkey % {len(TAGS)} + 1] || case when p_partkey % 48 >= 32 then ' ' || split_part(p_name, ' ', 1) else '' end as v from part),
u as (select p_partkey, trim(v) as raw, regexp_extract(trim(v), '(?is)^\[SCOPE:\s*(CONCEPT|MECHANIC|PRACTICE|EDGE_CASE|ANTI_PATTERN|PRINCIPLE|INSTANCE)\s*\]', 1) as tag from v),
n as (select distinct raw, replace(replace(upper(case when tag <> '' then tag else raw end), '-', '_'), ' ', '_') as name from u),
m as (select raw, any_value(name) as name, any_value(alias) filter (where alias = name) as hit, arg_min(scope, i) filter (where alias = name) as exact, arg_min(scope, i) filter (where contains(name, alias) or contains(alias, name)) as near from n, {ALIAS_SQL} group by raw)
select p_partkey, case when raw = '' then 'CONCEPT' when name in ('CONCEPT', 'MECHANIC', 'PRACTICE', 'EDGE_CASE', 'ANTI_PATTERN') then name else coalesce(exact, near, 'CONCEPT') end as scope from u join m using (raw)""")
def q159(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    tag = F.element_at(F.array(*[F.lit(x) for x in TAGS]), (p % len(TAGS) + 1).cast("int"))
    v = F.concat(tag, F.when(p % 48 >= 32, F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise(""))
    return t.part.select("p_partkey", texts.scope_of(v).alias("scope"))


@query("q160_meta_kind", "select event_id, case when event_id % 3 = 0 then 'k' || (props->>'$.k') when event_id % 3 = 1 then 'profile' else 'fact' end as kind from events")
def q160(t: Tables) -> DataFrame:
    """Kind from the metadata, else from the id's beginning."""
    e = F.col("event_id")
    meta = F.when(e % 3 == 0, F.concat(F.lit("k"), F.get_json_object("props", "$.k")))
    doc = F.when(e % 3 == 1, F.lit("profile_x")).otherwise(F.lit("doc_x"))
    return t.events.select("event_id", F.coalesce(meta, F.when(doc.startswith("profile"), "profile").otherwise("fact")).alias("kind"))


@query("q161_metadata_merge", "with a as (select doc_id, case when doc_id % 3 = 0 then ' ' else source end as s, string_split(text, chr(10))[1] as x, 1980 + doc_id % 60 as y from documents), b as (select doc_id, lang as s2, text as x2 from documents) select doc_id, case when trim(s) = '' then s2 else s end as source, case when length(x) < 40 and length(x2) > length(x) then x2 else x end as abstract, case when y between 1990 and 2100 then y end::bigint as year from a join b using (doc_id)")
def q161(t: Tables) -> DataFrame:
    """Blank values are filled, short texts give way to longer ones, impossible years go."""
    s = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("source"))
    x, x2, y = F.split("text", "\n")[0], F.col("text"), 1980 + F.col("doc_id") % 60
    return t.documents.select("doc_id", F.coalesce(F.when(F.trim(s) != "", s), F.col("lang")).alias("source"), F.when((F.length(x) < 40) & (F.length(x2) > F.length(x)), x2).otherwise(x).alias("abstract"), F.when(y.between(1990, 2100), y).alias("year"))


@query("q162_json_repair", "select event_id, (props->>'$.k')::int as k from events")
def q162(t: Tables) -> DataFrame:
    """The first object of a text, with trailing commas gone; null if it still doesn't parse."""
    broken = F.concat(F.lit("text ```json "), F.regexp_replace("props", r"\}", ",}"), F.lit(" ```"))
    body = F.regexp_replace(F.regexp_extract(broken, r"(?s)(\{.*\})", 1), r",\s*([}\]])", "$1")
    return t.events.select("event_id", F.from_json(body, "k int").getField("k").alias("k"))


@query("q162_partial_field", r"""
with r as (select event_id, '{"id": ' || event_id || ', "note": "' as head, event_type || ' \"so\" end' as enc, '", "p": ' || props || '}' as tail from events), c as (select *, (event_id * 37) % (length(head || enc || tail) + 1) as cut, length(head) as start from r),
p as (select *, case when cut >= start then left(enc, greatest(cut - start, 0)::int) else '' end as part from c)
select event_id, case when cut < start then 'missing' when cut >= start + length(enc) + 1 then 'complete' else 'partial' end as status, replace(case when part like '%\' then left(part, length(part) - 1) else part end, '\"', '"') as value from p""")
def q162_partial(t: Tables) -> DataFrame:
    """A field of objects that were cut somewhere."""
    from tidewell.functions.partial_json import partial_field

    return cut_objects(t).select("event_id", partial_field("raw", "note").alias("f")).select("event_id", "f.status", "f.value")


@query("q162_completed")
def q162_completed(t: Tables) -> DataFrame:
    """The same objects closed where they were cut."""
    from tidewell.functions.partial_json import completed

    return cut_objects(t).select("event_id", completed("raw").alias("c")).select("event_id", "c.status", "c.body")


def cut_objects(t: Tables) -> DataFrame:
    whole = F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "note": "'), F.col("event_type"), F.lit(' \\"so\\" end", "p": '), F.col("props"), F.lit("}"))
    return t.events.select("event_id", whole.alias("raw")).withColumn("raw", F.substring("raw", F.lit(1), F.pmod(F.col("event_id") * 37, F.length("raw") + 1).cast("int")))


@query("q163_dates", "select event_id, epoch_us(ts) // 1000000 as at, epoch_us(date_trunc('minute', ts) + interval 1 minute) // 1000000 as next_minute, strftime(ts - interval 8 hour, '%Y-%m-%d') as pacific_day from events")
def q163(t: Tables) -> DataFrame:
    pacific = F.date_format(F.from_utc_timestamp("ts", "America/Los_Angeles"), "yyyy-MM-dd")
    nxt = F.timestamp_add("MINUTE", F.lit(1), F.date_trunc("minute", "ts"))
    return t.events.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.unix_seconds(nxt).alias("next_minute"), pacific.alias("pacific_day"))


@query("q164_script", "with d as (select doc_id, case doc_id % 3 when 0 then repeat('Привет мир', (doc_id % 40)::int) || text when 1 then '123' else text end as t from documents) select doc_id, length(regexp_replace(t, '[^А-Яа-яЁё]', '', 'g')) < length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as latin from d")
def q164(t: Tables) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("Привет мир"), (F.col("doc_id") % 40).cast("int")), "text")).when(F.col("doc_id") % 3 == 1, "123").otherwise(F.col("text"))
    return t.documents.select("doc_id", texts.is_mostly_latin(text).alias("latin"))


@query("q165_slug", "select p_partkey, trim(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[^a-z0-9]+', '_', 'g'), '_') as slug from part")
def q165(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", texts.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))
