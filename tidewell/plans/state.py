"""Queues, rate windows, streams and pluggable functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import texts
from tidewell.operators import learning, queueing
from tidewell.plans.registry import Tables, query
from tidewell.streaming.run import scratch

STATUS = "case event_type when 'signup' then 'pending' when 'view' then 'running' when 'click' then 'running' when 'purchase' then 'completed' else 'failed' end"
LATEST_SQL = f"with j as (select user_id as job, ts, event_id, {STATUS} as status from events), s as (select job, arg_max(status, (ts, event_id)) as status, min(ts) as created_at, max(ts) as updated_at, arg_max(event_id, (ts, event_id)) as event_id from j group by job)"


def jobs(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("job"), "ts", "event_id", F.expr(STATUS).alias("status"))
    return queueing.latest_state(log, "job", "status", "ts", "event_id")


@query("q022_job_stream", 'select user_id::varchar as job_id, event_id as seq, event_type as event, rn - 1 as "offset" from (select *, row_number() over (partition by user_id order by event_id) as rn from events) where rn > 5')
def q022(t: Tables) -> DataFrame:
    """Events of all jobs from an offset, out of an append-only log."""
    from tidewell.sources.job_stream import append_events, read_events

    path = scratch(t.spark, "jobs")
    append_events(t.events.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event")), path)
    return read_events(t.spark, path, start=5).select("job_id", "seq", "event", F.col("offset").cast("long").alias("offset"))


@query("q166_job_states", LATEST_SQL + " select job, status, event_id from s")
def q166(t: Tables) -> DataFrame:
    return jobs(t).select("job", "status", "event_id")


@query("q166_claim", LATEST_SQL + " select job from s where status = 'pending' order by created_at, job limit 5")
def q166_claim(t: Tables) -> DataFrame:
    return queueing.claim(jobs(t), F.col("status") == "pending", 5, "created_at", "job").select("job")


@query("q166_state_stream")
def q166_stream(t: Tables) -> DataFrame:
    """The state machine as a stream: jobs with the number of steps they took."""
    from tidewell.streaming.rates import job_states
    from tidewell.streaming.run import drain, stream_folder

    log = stream_folder(t.spark, f"{t.folder}/events.parquet*", t.events)
    events = log.select(F.col("user_id").alias("job"), F.expr(STATUS).alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return drain(job_states(events, "job", "status", "ts", stale=None)).groupBy("job").agg(F.max("step").alias("steps"))


@query("q167_stale_recovery", LATEST_SQL + " select job, case when status = 'running' and timestamp '2024-01-31' - updated_at > interval 7200 second then 'failed' else status end as status, status = 'running' and timestamp '2024-01-31' - updated_at > interval 7200 second as stale from s")
def q167(t: Tables) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return queueing.recover(jobs(t), "status", "updated_at", now, 7200, "running", "failed").select("job", "status", "stale")


@query("q167_startup_requeue", LATEST_SQL + " select job, case when status = 'running' then 'pending' else status end as status, case when status <> 'running' and event_id % 3 = 0 then 'e' || event_id::varchar end as error, status = 'running' as requeued from s")
def q167_requeue(t: Tables) -> DataFrame:
    """At a worker's start every running job is queued again."""
    j = jobs(t).withColumn("error", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), "event_id")))
    return queueing.requeue(j, "status", "error", "running", "pending").select("job", "status", "error", "requeued")


@query("q168_active_duplicate", f"with j as (select user_id % 20 as node, user_id as job, ts, event_id, {STATUS} as status from events), s as (select node, job, arg_max(status, (ts, event_id)) as status, min(ts) created_at, max(ts) updated_at from j group by all) select node, arg_min(job, (created_at, job)) filter (where status in ('pending', 'running')) as active, arg_max(job, (updated_at, job)) filter (where status = 'completed') as done from s group by node")
def q168(t: Tables) -> DataFrame:
    """The oldest active and the newest completed job of each node."""
    j = jobs(t).withColumn("node", F.col("job") % 20)
    live = F.col("status").isin("pending", "running")
    return j.groupBy("node").agg(F.min_by("job", F.when(live, F.struct("created_at", "job"))).alias("active"), F.max_by("job", F.when(F.col("status") == "completed", F.struct("updated_at", "job"))).alias("done"))


@query("q169_running_count", LATEST_SQL + " select count(*) filter (where status = 'running' and updated_at >= timestamp '2024-01-31' - interval 2 day) as running, count(*) filter (where updated_at >= timestamp '2024-01-31' - interval 45 minute) as alive from s")
def q169(t: Tables) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return jobs(t).agg(F.count_if((F.col("status") == "running") & (F.col("updated_at") >= now - F.expr("INTERVAL 2 DAY"))).alias("running"), F.count_if(F.col("updated_at") >= now - F.expr("INTERVAL 45 MINUTE")).alias("alive"))


@query("q170_trailing_window", "select event_id, count(*) over w as requests, round(sum(value) over w, 4) as tokens from events window w as (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row)")
def q170(t: Tables) -> DataFrame:
    """Requests and tokens of the trailing day; an event exactly a day old is out."""
    r = learning.rolling(t.events, ["user_id"], "ts", 86_400, {"requests": F.lit(1), "tokens": F.col("value")})
    return r.select("event_id", "requests", F.round("tokens", 4).alias("tokens"))


@query("q170_window_stream", "select date_trunc('minute', ts) as minute, user_id, count(*) as n, round(sum(value), 4) as total from events group by all")
def q170_stream(t: Tables) -> DataFrame:
    """The same counts by minute out of a stream."""
    from tidewell.streaming.rates import minute_usage
    from tidewell.streaming.run import drain, stream_folder

    s = stream_folder(t.spark, f"{t.folder}/events.parquet*", t.events).withColumn("ts", F.col("ts").cast("timestamp"))
    return drain(minute_usage(s, "ts", "user_id", "value"), mode="complete").withColumn("total", F.round("total", 4)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


def budget_events(t: Tables) -> DataFrame:
    """Every third event tells what the last request used, the others ask; some only warm up."""
    prompt, i = (F.col("value") * 40).cast("long"), F.col("event_id")
    kind = F.when(i % 3 == 0, "reconcile").otherwise("reserve")
    return t.events.select("event_id", "user_id", "ts", kind.alias("kind"), prompt.alias("prompt"), (i % 5 * 20).alias("output"), prompt.alias("actual_prompt"), F.floor(prompt * (i % 4) / 4).alias("cached"), (i % 7).alias("completion"), (i % 17 == 0).alias("warm"))


@query("q170_admission")
def q170_admission(t: Tables) -> DataFrame:
    """Waits, reservations and what each user's window holds after every event."""
    from tidewell.operators.admission import admit

    a = admit(budget_events(t), ["user_id"], ["event_id"], F.col("ts"), max_requests=3, max_tokens=6000, window=86_400.0)
    return a.select("event_id", F.round("waited", 3).alias("waited"), "reserved", "requests", "tokens", F.round("factor", 6).alias("factor"))


@query("q171_moving_factor", "with r as (select user_id, value / 50 as x, row_number() over (partition by user_id order by ts desc) as back, count(*) over (partition by user_id) as n from events) select user_id, round(pow(0.8, max(n)) * 1.0 + sum(0.2 * pow(0.8, back - 1) * x), 6) as factor from r group by user_id")
def q171(t: Tables) -> DataFrame:
    e = t.events.withColumn("x", F.col("value") / 50)
    return queueing.moving_factor(e, ["user_id"], "ts", "x", start=1.0, share=0.2).select("user_id", F.round("factor", 6).alias("factor"))


@query("q172_stage_events", "select event_id, round((epoch_us(ts) - epoch_us(min(ts) over (partition by user_id))) / 1e6, 3) as since_start, lead(event_type) over (partition by user_id order by ts, event_id) as next_stage from events")
def q172(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.round((at - F.min(at).over(w)) / 1e6, 3).alias("since_start"), F.lead("event_type").over(w.orderBy("ts", "event_id")).alias("next_stage"))


@query("q175_versioned_upsert", "select conv_id, max(turn) as version, count(*) as facts from conversations group by conv_id")
def q175(t: Tables) -> DataFrame:
    """Facts of sessions merged batch by batch; an older version never overwrites a newer one."""
    from tidewell.operators.tables import upsert

    c = t.conversations
    base = c.where("turn < 3").groupBy("conv_id").agg(F.max("turn").alias("version"), F.count(F.lit(1)).alias("facts"))
    new = c.groupBy("conv_id").agg(F.max("turn").alias("version"), F.count(F.lit(1)).alias("facts"))
    fresh = new.join(base.select("conv_id", F.col("version").alias("_old")), "conv_id", "left").where("_old IS NULL OR version >= _old").drop("_old")
    return upsert(base, fresh, "conv_id")


@query("q175_stream_merge", "select conv_id::varchar as id, max(turn)::bigint as turn from conversations where conv_id is not null group by conv_id")
def q175_stream(t: Tables) -> DataFrame:
    """The last turn of each conversation, merged by id from three batches of a stream."""
    from tidewell.sources.vector_table import SCHEMA, VectorTable

    source, state, table = scratch(t.spark, "turns"), scratch(t.spark, "state"), VectorTable(t.spark, scratch(t.spark, "merged"))
    table.create()
    turns = t.conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("string").alias("id"), F.array(F.col("turn").cast("float")).alias("embedding"), F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("payload"), F.lit("m").alias("embed_model"))
    for low, high in ((0, 2), (2, 4), (4, 1 << 30)):  # the stream starts anew from its checkpoint each time
        turns.where((F.col("embedding")[0] >= low) & (F.col("embedding")[0] < high)).write.mode("append").parquet(source)
        table.merge_stream(t.spark.readStream.schema(SCHEMA).parquet(source), "turns", state, F.desc(F.col("embedding")[0]))
    return table.rows().select("id", F.col("payload")["turn"].cast("long").alias("turn"))


@query("q176_vector_backend", """
with a as (select vec_id, label, embedding::double[] as e from embeddings where vec_id % 7 <> 3), q as (select e.vec_id as v, e.embedding::double[] as w from embeddings e where e.vec_id = 0)
select vec_id::varchar as id, round(list_cosine_similarity(e, w), 5) as score, (select count(*) from a) as rows from a, q where label % 2 = 0 and vec_id % 5 <> 1 order by round(list_cosine_similarity(e, w), 5) desc, vec_id::varchar limit 10""")
def q176(t: Tables) -> DataFrame:
    """Create, upsert twice, delete, count and search a table with a filter."""
    from tidewell.sources.vector_table import VectorTable

    table = VectorTable(t.spark, scratch(t.spark, "vectors"))
    table.create()
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.create_map(F.lit("k"), (F.col("vec_id") % 5).cast("string"), F.lit("d"), (F.col("vec_id") % 7).cast("string")).alias("payload"), F.concat(F.lit("m"), F.col("label") % 2).alias("embed_model"))
    table.upsert(rows)
    again = rows.where("payload['k'] = '1'")
    stale = again.withColumn("payload", F.create_map(F.lit("k"), F.lit("0"))).withColumn("at", F.lit(1))
    table.upsert(again.withColumn("at", F.lit(2)).unionByName(stale), F.desc("at"))  # a batch that holds its ids twice
    table.delete(F.col("payload")["d"] == "3")
    first = [float(x) for x in t.embeddings.where("vec_id = 0").first().embedding]
    found = table.search(first, "m0", 10, F.col("payload")["k"] != "1", digits=5)
    return found.select("id", F.col("_score").alias("score"), F.lit(table.count()).alias("rows"))


TITLES_SQL = r"""
with p as (select url, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) as title from pages),
w as (select url, title, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: length(x) >= 3)) as w from p), q as (select item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) as k from benchmark),
s as (select distinct item_id, url, title, len(list_intersect(k, w))::double as score from q, w where len(list_intersect(k, w)) > 0),
h as (select 0 as i, 'even' as provider, * from s where length(url) % 2 = 0 qualify row_number() over (partition by item_id order by score desc, url) <= 5 union all select 1, 'all', * from s qualify row_number() over (partition by item_id order by score desc, url) <= 5)
select item_id as query_id, url, title, score, provider from h qualify row_number() over (partition by item_id, regexp_replace(lower(trim(url)), '/+$', '') order by i, score desc, url) = 1"""


@query("q177_provider_registry", TITLES_SQL)
def q177(t: Tables) -> DataFrame:
    """Hits of two providers for every query; of one address the first provider's stays."""
    from tidewell.sources.providers import Registry, table_provider

    r = Registry()
    titles = t.pages.select("url", texts.strip_tags(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))
    r.register("even", table_provider(titles.where(F.length("url") % 2 == 0), "url", "title", 5))
    r.register("all", table_provider(titles, "url", "title", 5))
    return r.search(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query("q178_injected_functions")
def q178(t: Tables) -> DataFrame:
    """Texts by an injected embedding, then pairs of a language that are near."""
    from tidewell.operators.dedup import similar_pairs
    from tidewell.operators.pluggable import embed

    d = embed(t.documents.select("doc_id", "lang", "text"), "text")
    return similar_pairs(d, "doc_id", "embedding", 0.95, within=["lang"]).select("a", "b", F.round("score", 4).alias("score"))


@query("q179_pluggable_signals", "with h as (select l_orderkey, l_linenumber, round(0.45 * least(1.0, greatest(0.0, l_discount * 10)) + 0.25 * coalesce(case when l_linenumber % 3 = 0 then null else l_tax * 12 end, 1.0) + 0.2 * least(1.0, ln(1 + l_quantity::int) / ln(41)) + 0.1 * 0.5, 6) as score from lineitem) select l_orderkey, l_linenumber, score from h qualify row_number() over (partition by l_orderkey order by score desc, l_linenumber) <= 2")
def q179(t: Tables) -> DataFrame:
    """The hybrid rank with the caller's own columns for its signals."""
    from tidewell.functions.scores import hybrid
    from tidewell.operators.ranking import top_per_group

    signals = hybrid(F.col("l_discount") * 10, F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax") * 12), F.col("l_quantity").cast("int"), F.lit(None).cast("int"), now=2025)
    s = t.lineitem.select("l_orderkey", "l_linenumber", signals.alias("score"))
    return top_per_group(s, ["l_orderkey"], 2, F.desc("score"), F.asc("l_linenumber"))


@query("q180_map_reduce", r"""
with s as (select conv_id, turn, unnest(range(len(x))) as i, unnest(x) as s from (select conv_id, turn, list_filter(string_split(regexp_replace(trim(text), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: length(y) >= 8) as x from conversations)),
f as (select conv_id, s, min((turn, i)) as spot from s group by all) select conv_id, string_agg(s, ' ' order by spot, s) as summary, count(*) as statements from f group by conv_id""")
def q180(t: Tables) -> DataFrame:
    """Statements of each window, then one summary a conversation."""
    from tidewell.operators.pluggable import map_reduce

    return map_reduce(t.conversations, ["conv_id"], lambda c: F.filter(texts.sentences(c), lambda s: F.length(s) >= 8), "text", "turn")


@query("q181_hashed_embedding", r"""
with w as (select conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '')) as w from conversations), h as (select conv_id, turn, ('0x' || substr(md5(w), 1, 8))::bigint as h from w),
s as (select conv_id, turn, h % 64 as pos, sum(case when (h >> 16) % 2 = 1 then 1 else -1 end) as x from h group by all) select conv_id, turn, pos, round(x / sqrt(sum(x * x) over (partition by conv_id, turn)), 6) as x from s qualify x <> 0""")
def q181(t: Tables) -> DataFrame:
    """Vectors of hashed words; places that are not zero."""
    from tidewell.operators.pluggable import embed

    v = embed(t.conversations.select("conv_id", "turn", "text"), "text").select("conv_id", "turn", F.posexplode("embedding").alias("pos", "x"))
    return v.where("x <> 0").select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))
