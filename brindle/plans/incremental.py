"""Incremental decisions, backfills, services and markup."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup as mk
from ..functions import text as t
from ..operators import gates as g
from ..operators import services as sv
from ..session import shared_folder
from ..sources.sinks import archive_split, content_hash, replace
from .tables import query, spread, sql, state, stories, summaries, table, usage


@query("post_changed", sql("stories state", """SELECT id, CASE WHEN p.story_id IS NULL THEN true WHEN id % 4 = 0 THEN false WHEN id % 7 = 0 THEN false ELSE p.input_hash IS DISTINCT FROM 'h' || id % 2 END AS changed
    FROM stories s LEFT JOIN state p ON p.story_id = s.id"""))
def post_changed(spark, sf):
    s, p = stories(spark, sf).select("id"), state(spark, sf)
    i = F.col("id")
    rule = g.post_changed(F.col("story_id").isNotNull(), False, i % 4 == 0, i % 7 != 0, F.col("input_hash"), F.concat(F.lit("h"), i % 2))
    return s.join(p, i == F.col("story_id"), "left").select("id", rule.alias("changed"))


@query("comments_changed", """WITH d AS (SELECT doc_id AS id, doc_id % 9 <> 0 AS has, doc_id % 10 = 1 AS failed, CASE WHEN doc_id % 6 = 0 THEN 'retryable' ELSE 'usable' END AS cs, doc_id % 5 = 0 AS cooling,
    CASE doc_id % 3 WHEN 0 THEN '4' WHEN 1 THEN '3' END AS policy, CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN doc_id % 7 <> 0 THEN (doc_id * 3) % 200 END AS processed, (doc_id * 37) % 260 AS descendants,
    'a' || doc_id % 2 AS sh, 'a' || doc_id % 3 AS nh FROM documents)
    SELECT id, CASE WHEN NOT has THEN true WHEN failed THEN true WHEN version = 2 AND cs = 'retryable' THEN true WHEN cooling THEN false WHEN policy IS NOT NULL AND policy <> '4' THEN true
    WHEN version = 2 AND NOT failed AND policy IS NOT DISTINCT FROM '4' AND processed IS NOT NULL THEN descendants - processed > 100 ELSE version <> 2 OR sh <> nh END AS changed FROM d""")
def comments_changed(spark, sf):
    d = table(spark, sf, "documents").selectExpr(
        "doc_id AS id", "doc_id % 9 <> 0 AS has_summary", "doc_id % 10 = 1 AS failed", "CASE WHEN doc_id % 6 = 0 THEN 'retryable' ELSE 'usable' END AS compress_state", "doc_id % 5 = 0 AS cooling",
        "CASE doc_id % 3 WHEN 0 THEN '4' WHEN 1 THEN '3' END AS policy", "CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 2 END AS version", "CASE WHEN doc_id % 7 <> 0 THEN (doc_id * 3) % 200 END AS processed",
        "(doc_id * 37) % 260 AS descendants", "concat('a', doc_id % 2) AS stored_hash", "concat('a', doc_id % 3) AS new_hash",
    )
    return d.select("id", g.comments_changed({c: F.col(c) for c in d.columns}, "4", 100).alias("changed"))


@query("notify_plan", sql("stories", """SELECT id FROM (SELECT id FROM stories ORDER BY time DESC, id DESC LIMIT 30) WHERE id % 6 <> 0 AND id % 4 <> 1"""))
def notify_plan(spark, sf):
    """Of the newest thirty stories, those neither in the ledger nor in this digest's progress."""
    newest = stories(spark, sf).orderBy(F.desc("time"), F.desc("id")).limit(30).select("id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return newest.join(docs.where("id % 6 = 0"), "id", "left_anti").join(docs.where("id % 4 = 1"), "id", "left_anti")


@query("deploy_quota", """WITH e AS (SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d-%H') AS slot FROM events), s AS (SELECT DISTINCT month, slot FROM e)
    SELECT month, slot, row_number() OVER (PARTITION BY month ORDER BY slot) AS used, row_number() OVER (PARTITION BY month ORDER BY slot) <= 500 AS allowed FROM s""")
def deploy_quota(spark, sf):
    """One deploy per hour slot, counted up through the month against its quota."""
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy-MM-dd-HH").alias("slot")).distinct()
    used = F.row_number().over(Window.partitionBy("month").orderBy("slot"))
    return e.withColumn("used", used).withColumn("allowed", F.col("used") <= 500)


@query("invalidate_cache", sql("summaries", "SELECT story_id, kind, CASE WHEN story_id % 4 = 0 THEN 0 ELSE length(summary) END AS chars FROM summaries WHERE NOT (story_id % 4 = 0) OR kind = 'post'"))
def invalidate_cache(spark, sf):
    """An emptied body reads as absent: posts of some ids are emptied, their comments are gone."""
    ids = table(spark, sf, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("story_id"), F.lit(True).alias("hit"))
    rows = summaries(spark, sf).join(ids, "story_id", "left").withColumn("summary", F.when(F.col("hit"), F.lit("")).otherwise(F.col("summary")))
    return rows.where("kind = 'post' OR hit IS NULL").select("story_id", "kind", F.length("summary").alias("chars"))


@query("compress_backfill", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'skip:no-blob' WHEN doc_id % 5 = 0 THEN 'skip:not-structured' WHEN doc_id % 11 = 0 THEN 'skip:degraded'
    WHEN doc_id % 2 = 0 THEN 'compress' ELSE 'skip:usable' END AS plan FROM documents""")
def compress_backfill(spark, sf):
    i = F.col("doc_id")
    state_ = g.compressed_state(F.lit("x"), F.when(i % 2 == 0, F.lit("old")).otherwise(F.lit("h")), F.lit("h"))
    plan = F.when(i % 7 == 0, "skip:no-blob").when(i % 5 == 0, "skip:not-structured").when(i % 11 == 0, "skip:degraded").when(state_ == "retryable", "compress").otherwise(F.concat(F.lit("skip:"), state_))
    return table(spark, sf, "documents").select("doc_id", plan.alias("plan"))


@query("stage_backfill", sql("summaries state", "SELECT m.story_id, CASE WHEN p.story_id IS NULL THEN 'failed' WHEN p.policy = '4' THEN 'skip' ELSE 'generate' END AS plan FROM summaries m LEFT JOIN state p ON p.story_id = m.story_id WHERE m.kind = 'comments'"))
def stage_backfill(spark, sf):
    m, p = summaries(spark, sf).where("kind = 'comments'").select("story_id"), state(spark, sf).select(F.col("story_id").alias("sid"), "policy")
    plan = F.when(F.col("sid").isNull(), "failed").when(F.col("policy") == "4", "skip").otherwise("generate")
    return m.join(p, m.story_id == p.sid, "left").select("story_id", plan.alias("plan"))


@query("resume_capture", sql("evaluation", """SELECT story_id, repeat FROM evaluation e WHERE variant = 'v1' AND NOT EXISTS (SELECT 1 FROM evaluation d WHERE d.variant = 'v2' AND d.validated AND d.story_id = e.story_id AND d.repeat = e.repeat)"""))
def resume_capture(spark, sf):
    """(story, repeat) pairs not yet captured and validated."""
    from .tables import evaluation

    e = evaluation(spark, sf)
    done = e.where("variant = 'v2' AND validated").select("story_id", "repeat")
    return e.where("variant = 'v1'").select("story_id", "repeat").join(done, ["story_id", "repeat"], "left_anti")


@query("breaker_open", sql("usage", "SELECT id, coalesce(max(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY gateway, model_requested ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS tripped FROM usage"))
def breaker_open(spark, sf):
    """Whether a call's gateway and model had failed before in the run."""
    calls, keys = usage(spark, sf).withColumn("at", F.struct("created_at", "id")), ["gateway", "model_requested"]
    first = calls.where("status = 'error'").groupBy(*keys).agg(F.min("at").alias("failed"))  # one row per gateway and model
    return calls.join(first, keys, "left").select("id", F.coalesce(F.col("at") > F.col("failed"), F.lit(False)).alias("tripped"))


@query("archive_plan", sql("stories", """SELECT id, substr(time_iso, 1, 10) AS day, CASE WHEN CAST(substr(time_iso, 1, 10) AS DATE) < DATE '2024-01-27' - 14 THEN 'archive/' || substr(time_iso, 1, 10) || '#' || id ELSE id::VARCHAR END AS ref FROM stories WHERE length(time_iso) > 10"""))
def archive_plan(spark, sf):
    rows = stories(spark, sf).where("length(time_iso) > 10").select("id", F.substring("time_iso", 1, 10).alias("day"), F.col("id").cast("string").alias("ref"))
    stays, goes = archive_split(rows, F.to_date("day"), "2024-01-27")
    return stays.unionByName(goes)


@query("run_lock", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN true ELSE (doc_id % 100) >= 55 END AS acquired FROM documents")
def run_lock(spark, sf):
    """A lock is taken if absent, unreadable or older than 55 minutes."""
    i = F.col("doc_id")
    at = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, F.lit("broken")).otherwise(F.date_format(F.timestamp_seconds(F.lit(1709251200) - (i % 100) * 60), "yyyy-MM-dd'T'HH:mm:ss'.000Z'"))
    return table(spark, sf, "documents").select("doc_id", (~g.in_cooldown(at, "2024-03-01 00:00:00", 55 * 60)).alias("acquired"))


@query("seen_migration", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 ELSE doc_id END AS top, CASE WHEN doc_id % 3 = 0 THEN '1970-01-01T00:00:00.000Z' ELSE 'now' END AS at FROM documents")
def seen_migration(spark, sf):
    """Old cache rows under their old name, with the epoch for a missing time."""
    old = table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 END AS seen_kids", "CASE WHEN doc_id % 2 = 1 THEN doc_id END AS seen_top_level", "CASE WHEN doc_id % 3 <> 0 THEN 'now' END AS at")
    return old.select("doc_id", F.coalesce("seen_top_level", "seen_kids").alias("top"), F.coalesce("at", F.lit("1970-01-01T00:00:00.000Z")).alias("at"))


@query("index_stability", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE 'old' END AS updated FROM conversations GROUP BY conv_id")
def index_stability(spark, sf):
    """An index whose id list is the same keeps its old time."""
    ids = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("now"))
    before = F.when(F.col("conv_id") % 3 == 0, F.slice("now", 2, 1000)).otherwise(F.col("now"))
    return ids.select("conv_id", F.when(before == F.col("now"), F.lit("old")).otherwise(F.lit("new")).alias("updated"))


@query("skip_unchanged", """SELECT (SELECT count(*) FROM (FROM labels EXCEPT ALL SELECT * FROM labels ORDER BY doc_id DESC)) = 0 AS same_rows,
    (SELECT count(*) FROM (FROM labels EXCEPT ALL SELECT * FROM labels WHERE doc_id % 2 = 0)) = 0 AS other_rows""")
def skip_unchanged(spark, sf):
    """Whether a write could be skipped: equal rows in another order are the same content."""
    d = table(spark, sf, "labels")
    same, other = content_hash(d) == content_hash(d.orderBy(F.desc("doc_id"))), content_hash(d) == content_hash(d.where("doc_id % 2 = 0"))
    return spark.createDataFrame([(same, other)], "same_rows boolean, other_rows boolean")


# Markup and services: no SQL form


@query("page_extract")
def page_extract(spark, sf):
    """Article text of every page as Markdown, and its verdict."""
    from ..functions.quality import extract_metrics, is_article

    md = spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", mk.batched(mk.page_markdown, "string", F.col("html")).alias("md"))
    return md.select("page_id", F.length("md").alias("chars"), F.sha2("md", 256).alias("sha"), is_article(extract_metrics(F.col("md"))).alias("article"))


@query("plain_comments")
def plain_comments(spark, sf):
    p = spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", mk.batched(mk.html_plain, "string", F.col("html")).alias("plain"))
    return p.select("page_id", F.length("plain").alias("chars"), F.sha2("plain", 256).alias("sha"))


@query("render_html")
def render_html(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", mk.batched(mk.markdown_html, "string", F.col("text")).alias("html"))
    return d.select("doc_id", F.length("html").alias("chars"), F.sha2("html", 256).alias("sha"))


@query("message_chunks")
def message_chunks(spark, sf):
    """Texts in pieces for a chat; together they are the text."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(mk.batched(mk.chunks, "array<string>", F.col("text"))).alias("pos", "chunk"))
    return d.select("doc_id", "pos", F.length("chunk").alias("chars"))


@query("chat_messages")
def chat_messages(spark, sf):
    s = stories(spark, sf).where("url IS NOT NULL").join(summaries(spark, sf).where("kind = 'post'"), F.col("id") == F.col("story_id"))
    return s.select("id", F.length(mk.batched(lambda a, b, c, d: mk.message(a, b, c, d, 400), "string", F.col("title"), F.col("url"), F.col("summary"), t.teaser(F.col("summary")))).alias("chars"))


@query("balanced_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def balanced_json(spark, sf):
    """The object in a chatty answer."""
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("none {")).otherwise(F.concat(F.lit('Sure: {"x":"}{"} no, '), F.col("props"), F.lit(" done {")))
    raw = F.replace(raw, F.lit('{"x":"}{"} no, '), F.lit(""))
    e = table(spark, sf, "events").select("event_id", mk.batched(mk.first_object, "string", raw).alias("o"))
    return e.select("event_id", F.get_json_object("o", "$.k").cast("long").alias("k"))


@query("unicode_forms")
def unicode_forms(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", mk.nfkc(F.concat("text", F.lit(" ﬁ①"))).alias("x"))
    return d.select("doc_id", F.length("x").alias("chars"), F.col("x").endswith("fi1").alias("folded"))


MODELS = ["busy", "broken", "small"]


@query("generated_summaries")
def generated_summaries(spark, sf):
    """Summaries along a chain of stand-in models: the first is rate limited, the second fails twice."""
    prompts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), t.head_tail(F.col("text"), 900, 600, 200).alias("prompt"))
    out = sv.generate(prompts, sv.EchoModel({"busy": 429, "broken": 500}), MODELS)
    return out.select("id", F.length("text").alias("chars"), "model", F.size("attempts").alias("attempts"))


@query("generated_usage")
def generated_usage(spark, sf):
    prompts = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("a b c d").alias("prompt"))
    used = sv.ledger(sv.generate(prompts, sv.EchoModel({"busy": 429, "broken": 500}, frozenset({"small"})), MODELS, structured=True), "tags")
    return used.groupBy("model_requested", "status").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("tokens"))


@query("stream_equals_batch", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_equals_batch(spark, sf):
    """Hourly counts of the events table read as a stream."""
    from ..streaming.microbatch import windowed_counts

    folder = shared_folder(spark, "counts")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(stream)
    put = lambda batch, _: replace(batch, f"{folder}/table")
    q = counts.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/table").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
