"""Joins, set operations, sorts and state of the published collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import search as se
from ..functions import text as t
from ..functions.dates import date_key, iso_week_key
from ..operators import assemble as a
from ..operators import gates as g
from ..operators import state as st
from .filters import GATE, HOST, duck_line, duck_trim, duck_words
from .tables import comments, query, sql, state, stories, story_tags, summaries, table, usage
from .texts import DROP_LIST, trigger_sql

TS = "try_strptime(time_iso, '%Y-%m-%dT%H:%M:%S.000Z')"
TAG_LIST = "taglists AS (SELECT story_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS tags FROM (SELECT story_id, list(tag ORDER BY pos) AS l FROM story_tags GROUP BY story_id))"
PUBLISHED = f"""{TAG_LIST}, {trigger_sql("SELECT story_id, summary AS raw FROM summaries WHERE kind = 'post'", "story_id")}, published AS (SELECT s.*, {duck_trim('m.summary')} AS post, c.summary AS comments_text, tags, {HOST} AS domain, {TS} AS ts
    FROM stories s JOIN summaries m ON m.story_id = s.id AND m.kind = 'post' AND coalesce(m.guard_ok, true) JOIN found f ON f.story_id = s.id AND NOT list_has_any(f.reasons, {DROP_LIST}) LEFT JOIN summaries c ON c.story_id = s.id AND c.kind = 'comments'
    LEFT JOIN taglists x ON x.story_id = s.id WHERE coalesce(score, 0) >= 75 AND {GATE} AND {duck_trim('m.summary')} <> '')"""
NEEDS = "stories summaries story_tags"


def ts():
    return F.try_to_timestamp("time_iso", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))


def collection(spark, sf):
    return a.published(stories(spark, sf), summaries(spark, sf), story_tags(spark, sf)).withColumn("ts", ts())


def in_places(spark, sf):
    """The collection with places: newest day first, items without a time last."""
    return a.placed(collection(spark, sf), F.to_date("ts"), lambda b: b.desc_nulls_last(), a.newest_first(F.col("ts"), F.col("id")))


@query("assemble_publish", sql(NEEDS, "SELECT id, title, domain, array_to_string(tags, ',') AS tags, length(post) AS post_chars, length(comments_text) AS comments_chars, coalesce(score, 0) AS score, descendants AS comments_count, row_number() OVER (ORDER BY ts DESC NULLS LAST, id DESC) AS place FROM published", PUBLISHED))
def assemble_publish(spark, sf):
    """The flagship: the collection in published order."""
    items = in_places(spark, sf)
    return items.select(
        "id", "title", "domain", F.array_join("tags", ",").alias("tags"), F.length("post").alias("post_chars"), F.length("comments_text").alias("comments_chars"),
        g.zero(F.col("score")).alias("score"), "comments_count", "place",
    )


@query("assemble_db", sql("stories summaries", """SELECT s.id, length(p.post) AS post, length(p.comments) AS comments FROM stories s LEFT JOIN
    (SELECT story_id, max(summary) FILTER (kind = 'post') AS post, max(summary) FILTER (kind = 'comments') AS comments FROM summaries WHERE lang = 'en' GROUP BY story_id) p ON p.story_id = s.id"""))
def assemble_db(spark, sf):
    p = a.pivot_summaries(summaries(spark, sf))
    return stories(spark, sf).join(p, F.col("id") == F.col("story_id"), "left").select("id", F.length("post").alias("post"), F.length("comments").alias("comments"))


@query("sanitize_stored", sql("summaries", f"SELECT m.story_id, sha256({duck_trim('m.summary')}) AS sha FROM summaries m JOIN found f ON f.story_id = m.story_id AND NOT list_has_any(f.reasons, {DROP_LIST}) WHERE m.kind = 'post'", trigger_sql("SELECT story_id, summary AS raw FROM summaries WHERE kind = 'post'", "story_id")))
def sanitize_stored(spark, sf):
    """Post summaries of the relational store, which has no guard: replacement characters go, triggers drop."""
    clean = a.cleaned(F.concat("summary", F.lit("\ufffd")), "\ufffd")
    return summaries(spark, sf).where("kind = 'post'").where(a.stays(clean)).select("story_id", F.sha2(clean, 256).alias("sha"))


@query("publish_order", sql("stories", f"SELECT id FROM (SELECT id, {TS} AS ts FROM stories) ORDER BY ts DESC NULLS LAST, id DESC LIMIT 40"))
def publish_order(spark, sf):
    """The newest forty, a top-k report."""
    return stories(spark, sf).withColumn("ts", ts()).orderBy(*a.newest_first(F.col("ts"), F.col("id"))).limit(40).select("id")


@query("fallback_text", sql("comments", f"""SELECT story_id, substr({duck_line("string_agg(substr(" + duck_line('text') + ", 1, 280), ' ' ORDER BY pos)")}, 1, 280) AS fallback FROM comments GROUP BY story_id"""))
def fallback_text(spark, sf):
    return a.fallback_text(comments(spark, sf))


@query("comments_choice", sql("summaries", """SELECT story_id, CASE WHEN story_id % 4 = 0 THEN 'short' WHEN story_id % 2 = 0 THEN '' ELSE 'raw' END AS shown FROM summaries WHERE kind = 'comments'"""))
def comments_choice(spark, sf):
    i = F.col("story_id")
    shown = a.comments_text(F.lit("short"), F.when(i % 4 == 0, F.lit("usable")).otherwise(F.lit("retryable")), F.lit(""), i % 2 == 0, F.lit("raw"))
    return summaries(spark, sf).where("kind = 'comments'").select("story_id", shown.alias("shown"))


@query("group_daily", sql(NEEDS, "SELECT substr(time_iso, 1, 10) AS key, row_number() OVER (PARTITION BY substr(time_iso, 1, 10) ORDER BY ts DESC NULLS LAST, id DESC) - 1 AS pos, id FROM published WHERE length(time_iso) >= 10", PUBLISHED))
def group_daily(spark, sf):
    items = collection(spark, sf).where("length(time_iso) >= 10")
    return a.grouped_ids(items, date_key(F.col("time_iso")), a.newest_first(F.col("ts"), F.col("id")))


@query("group_weekly", sql(NEEDS, "SELECT key, row_number() OVER (PARTITION BY key ORDER BY ts DESC NULLS LAST, id DESC) - 1 AS pos, id FROM (SELECT *, strftime(ts, '%G-w%V') AS key FROM published WHERE ts IS NOT NULL)", PUBLISHED))
def group_weekly(spark, sf):
    items = collection(spark, sf).where("ts IS NOT NULL")
    return a.grouped_ids(items, iso_week_key(F.col("time_iso")), a.newest_first(F.col("ts"), F.col("id")))


@query("search_index", sql(NEEDS, "SELECT id, title, coalesce(array_to_string(tags, ','), '') AS tags, time_iso, coalesce(score, 0) AS score, domain FROM published", PUBLISHED))
def search_index(spark, sf):
    return a.search_index(collection(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@query("tag_counts", sql("story_tags", "SELECT tag, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, tag) AS place FROM story_tags GROUP BY tag"))
def tag_counts(spark, sf):
    counted = story_tags(spark, sf).groupBy("tag").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "tag")))  # one row per tag


@query("tags_popular", sql("story_tags", "SELECT t.story_id, t.pos, t.tag, CASE WHEN c.n >= 3 THEN 'tag/' || t.tag ELSE 'search/?tags=' || t.tag END AS href FROM story_tags t JOIN (SELECT tag, count(*) AS n FROM story_tags GROUP BY tag) c ON c.tag = t.tag"))
def tags_popular(spark, sf):
    tags = story_tags(spark, sf)
    counted = tags.groupBy("tag").agg(F.count("*").alias("n"))
    href = F.when(F.col("n") >= g.POPULAR_TAG, F.concat(F.lit("tag/"), "tag")).otherwise(F.concat(F.lit("search/?tags="), "tag"))
    return tags.join(counted, "tag").select("story_id", "pos", "tag", href.alias("href"))


@query("tag_pages", sql("story_tags stories", f"SELECT t.tag, s.id, row_number() OVER (PARTITION BY t.tag ORDER BY {TS} DESC NULLS LAST, s.id DESC) AS place FROM (SELECT DISTINCT tag, story_id FROM story_tags) t JOIN stories s ON s.id = t.story_id"))
def tag_pages(spark, sf):
    members = story_tags(spark, sf).select("tag", F.col("story_id").alias("id")).distinct()
    rows = members.join(stories(spark, sf).select("id", ts().alias("ts")), "id")
    return rows.select("tag", "id", F.row_number().over(Window.partitionBy("tag").orderBy(*a.newest_first(F.col("ts"), F.col("id")))).alias("place"))


@query("page_n", sql(NEEDS, "SELECT id, (row_number() OVER (ORDER BY ts DESC NULLS LAST, id DESC) - 1) // 10 + 1 AS page, greatest(1, (count(*) OVER () + 9) // 10) AS pages FROM published", PUBLISHED))
def page_n(spark, sf):
    """Every item's page of ten."""
    items = in_places(spark, sf)
    return items.select("id", F.floor((F.col("place") - 1) / 10 + 1).alias("page"), F.greatest(F.lit(1), F.ceil(F.col("total") / 10)).alias("pages"))


@query("pick_by_ids", sql("stories", "SELECT pos, id, title FROM (SELECT doc_id AS did, unnest([doc_id * 3, doc_id, doc_id * 3, -1]) AS id, unnest([0, 1, 2, 3]) AS pos FROM documents) x JOIN stories USING (id) WHERE NOT (pos = 2) AND NOT (pos = 1 AND did = 0)"))
def pick_by_ids(spark, sf):
    """Items of id lists in list order: repeated ids once, missing ones left out."""
    lists = table(spark, sf, "documents").select("doc_id", F.posexplode(F.expr("array(doc_id * 3, doc_id, doc_id * 3, -1)")).alias("pos", "id"))
    first = st.latest_wins(lists, ["doc_id", "id"], [F.col("pos")])
    return first.join(stories(spark, sf).select("id", "title"), "id").select("pos", "id", "title")


POLICY_OPEN = " OR ".join(f"p.{c} IS NULL OR p.{c} <> 'ok'" for c in ("post_status", "comments_status", "tags_status")) + " OR p.policy IS NULL OR p.policy <> '4'"
CUTOFF = "2024-01-20T00:00:00.000Z"


@query("pending_select", sql("stories state", f"""SELECT s.id, s.descendants AS rank FROM stories s LEFT JOIN state p ON p.story_id = s.id
    WHERE p.story_id IS NULL OR (({POLICY_OPEN}) AND (p.updated_at IS NULL OR p.updated_at < '{CUTOFF}')) ORDER BY s.descendants ASC NULLS FIRST, s.id DESC LIMIT 200"""))
def pending_select(spark, sf):
    return st.pending(stories(spark, sf).withColumnRenamed("descendants", "rank"), state(spark, sf), "4", CUTOFF, 500)


@query("legacy_backlog", sql("stories state", f"""SELECT s.id FROM stories s JOIN (SELECT doc_id AS story_id, CASE WHEN doc_id % 4 <> 0 THEN 'html' END AS source_kind FROM documents WHERE doc_id % 2 = 0) e ON e.story_id = s.id
    LEFT JOIN state p ON p.story_id = s.id WHERE e.source_kind IS NULL AND s.url IS NOT NULL AND trim(s.url) <> '' AND (p.updated_at IS NULL OR p.updated_at < '{CUTOFF}')
    ORDER BY coalesce(p.updated_at, s.time_iso, '') , s.id LIMIT 100"""))
def legacy_backlog(spark, sf):
    """Extracts of no known kind whose story has a URL, oldest first; the next hundred."""
    e = table(spark, sf, "documents").where("doc_id % 2 = 0").selectExpr("doc_id AS story_id", "CASE WHEN doc_id % 4 <> 0 THEN 'html' END AS source_kind").where("source_kind IS NULL")
    s, p = stories(spark, sf).where("url IS NOT NULL AND trim(url) <> ''"), state(spark, sf).select(F.col("story_id").alias("pid"), "updated_at")
    rows = e.join(s, F.col("story_id") == F.col("id")).join(p, F.col("pid") == F.col("id"), "left").where((F.col("updated_at").isNull()) | (F.col("updated_at") < CUTOFF))
    return rows.orderBy(F.coalesce("updated_at", "time_iso", F.lit("")), "id").limit(100).select("id")


LEDGER = "SELECT doc_id AS story_id FROM documents WHERE doc_id % 6 = 0"


def ledger(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 6 = 0").select(F.col("doc_id").alias("story_id"))


@query("anti_sent", sql("stories", f"SELECT id FROM stories WHERE id NOT IN ({LEDGER})"))
def anti_sent(spark, sf):
    return stories(spark, sf).select("id").join(ledger(spark, sf).withColumnRenamed("story_id", "id"), "id", "left_anti")


@query("sent_union", f"SELECT DISTINCT id FROM (SELECT story_id AS id FROM ({LEDGER}) UNION ALL SELECT doc_id FROM labels)")
def sent_union(spark, sf):
    return ledger(spark, sf).union(table(spark, sf, "labels").select("doc_id")).distinct().withColumnRenamed("story_id", "id")


@query("newest_n", sql("stories summaries", f"SELECT id FROM stories s SEMI JOIN summaries m ON m.story_id = s.id AND m.kind = 'post' AND {duck_trim('m.summary')} <> '' ORDER BY {TS} DESC NULLS LAST, id DESC LIMIT 25"))
def newest_n(spark, sf):
    """The newest 25 stories with a summary: a notification's candidates."""
    with_summary = summaries(spark, sf).where("kind = 'post'").where(g.has_summary(F.col("summary"))).select(F.col("story_id").alias("id"))
    return stories(spark, sf).join(with_summary, "id", "left_semi").withColumn("ts", ts()).orderBy(*a.newest_first(F.col("ts"), F.col("id"))).limit(25).select("id")


@query("orphans", sql("stories summaries", "SELECT DISTINCT story_id FROM summaries WHERE story_id NOT IN (SELECT id FROM stories WHERE id % 2 = 0) AND story_id NOT IN (SELECT id FROM stories WHERE score > 100)"))
def orphans(spark, sf):
    s, ids = stories(spark, sf), summaries(spark, sf).select("story_id").distinct()
    index, published = s.where("id % 2 = 0").select(F.col("id").alias("story_id")), s.where("score > 100").select(F.col("id").alias("story_id"))
    return ids.join(index, "story_id", "left_anti").join(published, "story_id", "left_anti")


@query("missing_outputs", sql("stories summaries story_tags", """SELECT s.id, p.story_id IS NULL AS no_post, c.story_id IS NULL AS no_comments FROM stories s
    LEFT JOIN (SELECT story_id FROM summaries WHERE kind = 'post') p ON p.story_id = s.id LEFT JOIN (SELECT story_id FROM summaries WHERE kind = 'comments') c ON c.story_id = s.id
    WHERE s.time >= 1704500000 AND (p.story_id IS NULL OR c.story_id IS NULL)"""))
def missing_outputs(spark, sf):
    m = a.pivot_summaries(summaries(spark, sf), ("en", "ru"))
    rows = stories(spark, sf).where("time >= 1704500000").join(m, F.col("id") == F.col("story_id"), "left").where("post IS NULL OR comments IS NULL")
    return rows.select("id", F.col("post").isNull().alias("no_post"), F.col("comments").isNull().alias("no_comments"))


@query("cascade_delete", sql("stories summaries story_tags state", """, doomed AS (SELECT id FROM stories WHERE coalesce(score, 0) < 50),
    kept AS (SELECT 'stories' AS name, id FROM stories UNION ALL SELECT 'summaries', story_id FROM summaries UNION ALL SELECT 'tags', story_id FROM story_tags UNION ALL SELECT 'state', story_id FROM state)
    SELECT name, count(*) AS left_over, count(DISTINCT id) AS ids FROM kept WHERE id NOT IN (SELECT id FROM doomed) GROUP BY name""".lstrip(", ").join([", ", ""])))
def cascade_delete(spark, sf):
    s = stories(spark, sf)
    tables = {"stories": (s, "id"), "summaries": (summaries(spark, sf), "story_id"), "tags": (story_tags(spark, sf), "story_id"), "state": (state(spark, sf), "story_id")}
    kept = st.cascade(tables, st.doomed(s, g.CLEANUP_FLOOR))
    parts = [rows.select(F.lit(name).alias("name"), F.col(tables[name][1]).alias("id")) for name, rows in kept.items()]
    return reduce(lambda x, y: x.unionAll(y), parts).groupBy("name").agg(F.count("*").alias("left_over"), F.countDistinct("id").alias("ids"))


@query("upsert_latest", sql("summaries", """SELECT coalesce(n.story_id, o.story_id) AS story_id, coalesce(n.kind, o.kind) AS kind, CASE WHEN n.story_id IS NOT NULL THEN n.lang ELSE o.lang END AS lang,
    CASE WHEN n.story_id IS NOT NULL THEN n.chars ELSE o.chars END AS chars FROM (SELECT story_id, kind, lang, length(summary) AS chars FROM summaries) o
    FULL JOIN (SELECT doc_id AS story_id, 'post' AS kind, lang, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars END AS chars FROM documents WHERE doc_id % 3 = 0) n ON n.story_id = o.story_id AND n.kind = o.kind"""))
def upsert_latest(spark, sf):
    old = summaries(spark, sf).select("story_id", "kind", "lang", F.length("summary").cast("long").alias("chars"))
    new = table(spark, sf, "documents").where("doc_id % 3 = 0").selectExpr("doc_id AS story_id", "'post' AS kind", "lang", "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars END AS chars")
    return st.upsert(old, new, ["story_id", "kind"])


@query("upsert_coalesce", sql("state", """SELECT coalesce(n.story_id, o.story_id) AS story_id, CASE WHEN n.story_id IS NOT NULL THEN n.post_status ELSE o.post_status END AS post_status,
    coalesce(n.policy, o.policy) AS policy, coalesce(n.input_hash, o.input_hash) AS input_hash FROM state o FULL JOIN (SELECT doc_id AS story_id, 'ok' AS post_status, CASE WHEN doc_id % 2 = 0 THEN '5' END AS policy, CAST(NULL AS VARCHAR) AS input_hash FROM documents WHERE doc_id % 5 < 2) n ON n.story_id = o.story_id"""))
def upsert_coalesce(spark, sf):
    old = state(spark, sf).select("story_id", "post_status", "policy", "input_hash")
    new = table(spark, sf, "documents").where("doc_id % 5 < 2").selectExpr("doc_id AS story_id", "'ok' AS post_status", "CASE WHEN doc_id % 2 = 0 THEN '5' END AS policy", "CAST(NULL AS string) AS input_hash")
    return st.upsert(old, new, ["story_id"], keep=("policy", "input_hash"))


@query("replace_tags", sql("story_tags", "SELECT story_id, tag FROM story_tags WHERE story_id % 3 <> 0 UNION ALL SELECT DISTINCT doc_id, unnest(['new', 'new', lang]) FROM documents WHERE doc_id % 3 = 0"))
def replace_tags(spark, sf):
    new = table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("story_id"), F.explode(F.array(F.lit("new"), F.lit("new"), F.col("lang"))).alias("tag"))
    return st.replace_children(story_tags(spark, sf).select("story_id", "tag"), new, "story_id")


@query("change_detect", """WITH old AS (SELECT doc_id AS id, lang, source FROM documents WHERE doc_id % 10 <> 0), new AS (SELECT doc_id AS id, lang, CASE WHEN doc_id % 10 = 2 THEN 'src1' ELSE source END AS source FROM documents WHERE doc_id % 10 <> 1)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON n.id = o.id
    WHERE o.id IS NULL OR n.id IS NULL OR (o.lang, o.source) IS DISTINCT FROM (n.lang, n.source)""")
def change_detect(spark, sf):
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 10 <> 0").selectExpr("doc_id AS id", "lang", "source")
    new = d.where("doc_id % 10 <> 1").selectExpr("doc_id AS id", "lang", "CASE WHEN doc_id % 10 = 2 THEN 'src1' ELSE source END AS source")
    return st.changes(old, new, "id")


@query("merge_collections", sql("stories", "SELECT id, CASE WHEN id % 2 = 0 THEN coalesce(score, 0) + 10 ELSE coalesce(score, 0) END AS score FROM stories WHERE CASE WHEN id % 2 = 0 THEN coalesce(score, 0) + 10 ELSE coalesce(score, 0) END >= 75"))
def merge_collections(spark, sf):
    s = stories(spark, sf).select("id", g.zero(F.col("score")).alias("score"))
    return st.merge_collections(s, s.where("id % 2 = 0").withColumn("score", F.col("score") + 10), "id", F.col("score") >= 75)


@query("policy_mismatch", sql("stories state", "SELECT id, p.story_id IS NULL AS no_state FROM stories s LEFT JOIN state p ON p.story_id = s.id WHERE p.policy IS DISTINCT FROM '4' OR p.input_hash IS DISTINCT FROM 'h' || id % 2"))
def policy_mismatch(spark, sf):
    s, p = stories(spark, sf).select("id"), state(spark, sf)
    rows = s.join(p, F.col("id") == F.col("story_id"), "left")
    stale = ~F.col("policy").eqNullSafe(F.lit("4")) | ~F.col("input_hash").eqNullSafe(F.concat(F.lit("h"), F.col("id") % 2))
    return rows.where(stale).select("id", F.col("story_id").isNull().alias("no_state"))


@query("input_hash_changed", """SELECT doc_id, sha256(concat_ws('|', lang, '4', text)) <> sha256(concat_ws('|', lang, CASE WHEN doc_id % 4 = 0 THEN '5' ELSE '4' END, CASE WHEN lang = 'de' THEN trim(text) ELSE text END)) AS changed FROM documents""")
def input_hash_changed(spark, sf):
    d = table(spark, sf, "documents")
    stored = d.select("doc_id", st.input_hash(F.col("lang"), F.lit("4"), F.col("text")).alias("old"))
    now = d.select("doc_id", st.input_hash(F.col("lang"), F.when(F.col("doc_id") % 4 == 0, F.lit("5")).otherwise(F.lit("4")), F.when(F.col("lang") == "de", F.trim("text")).otherwise(F.col("text"))).alias("new"))
    return now.join(stored, "doc_id").select("doc_id", (F.col("old") != F.col("new")).alias("changed"))


@query("candidate_priority", sql("stories state", f"""SELECT s.id, (p.post_status IS DISTINCT FROM 'ok')::INT + 2 * (p.comments_status IS DISTINCT FROM 'ok')::INT AS priority FROM stories s LEFT JOIN state p ON p.story_id = s.id
    WHERE {GATE} AND (p.post_status IS DISTINCT FROM 'ok' OR p.comments_status IS DISTINCT FROM 'ok') ORDER BY 2 DESC, {TS} DESC NULLS LAST, id DESC LIMIT 30"""))
def candidate_priority(spark, sf):
    """The thirty most urgent stories: 1 for the post, 2 for its comments."""
    s, p = stories(spark, sf).where(g.passes_gate(F.col("score"), F.col("descendants"))), state(spark, sf)
    bad = lambda c: (~F.col(c).eqNullSafe(F.lit("ok"))).cast("int")
    rows = s.join(p, F.col("id") == F.col("story_id"), "left").withColumn("priority", bad("post_status") + 2 * bad("comments_status")).where("priority > 0")
    return rows.withColumn("ts", ts()).orderBy(F.desc("priority"), *a.newest_first(F.col("ts"), F.col("id"))).limit(30).select("id", "priority")


@query("id_list", sql("stories", "SELECT id, descendants FROM stories WHERE coalesce(score, 0) >= 75 ORDER BY descendants ASC NULLS FIRST, id DESC LIMIT 50"))
def id_list(spark, sf):
    return stories(spark, sf).where(g.zero(F.col("score")) >= 75).orderBy(F.col("descendants").asc_nulls_first(), F.desc("id")).limit(50).select("id", "descendants")


@query("set_members", """SELECT conv_id, count(DISTINCT role) AS roles, list_sort(list_distinct(list(role))) = ['assistant', 'user'] AS same_members, list(role ORDER BY turn) = ['user', 'assistant', 'user', 'assistant'] AS same_list FROM conversations GROUP BY conv_id""")
def set_members(spark, sf):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(roles.alias("r"))
    want = F.array(F.lit("assistant"), F.lit("user"))
    four = F.array(*map(F.lit, ("user", "assistant", "user", "assistant")))
    return c.select("conv_id", F.size(F.array_distinct("r")).alias("roles"), (F.array_sort(F.array_distinct("r")) == want).alias("same_members"), (F.col("r") == four).alias("same_list"))


@query("source_union", sql("stories", "SELECT id, min(src) AS source FROM (SELECT id, 0 AS src FROM stories WHERE score > 200 UNION ALL SELECT id, 1 FROM stories WHERE id % 3 = 0 UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY id"))
def source_union(spark, sf):
    """Ids of three sources, each with the first source that has it."""
    s = stories(spark, sf)
    every = s.where("score > 200").select("id", F.lit(0).alias("source")).unionAll(s.where("id % 3 = 0").select("id", F.lit(1))).unionAll(table(spark, sf, "labels").select("doc_id", F.lit(2)))
    return every.groupBy("id").agg(F.min("source").alias("source"))


@query("pool_union", sql("stories", "SELECT id FROM (SELECT id, min(o) AS o FROM (SELECT id, row_number() OVER (ORDER BY score DESC NULLS LAST, id DESC) AS o FROM stories UNION ALL SELECT id, 100000000 + row_number() OVER (ORDER BY descendants DESC NULLS LAST, id DESC) FROM stories) GROUP BY id) ORDER BY o LIMIT 60"))
def pool_union(spark, sf):
    """The best stories, then the most discussed, each once, sixty in all: equals the sixty best by votes where they are that many."""
    s = stories(spark, sf)
    best = s.orderBy(F.col("score").desc_nulls_last(), F.desc("id")).limit(60).select("id", F.lit(0).alias("src"), "score")
    most = s.orderBy(F.col("descendants").desc_nulls_last(), F.desc("id")).limit(60).select("id", F.lit(1).alias("src"), F.col("descendants").alias("score"))
    once = st.latest_wins(best.unionAll(most), ["id"], [F.col("src")])
    return once.orderBy("src", F.col("score").desc_nulls_last(), F.desc("id")).limit(60).select("id")


@query("window_union", "SELECT event_id FROM (SELECT event_id, ts FROM events WHERE epoch(ts) >= 1704067200 AND epoch(ts) < 1704153600 UNION SELECT event_id, ts FROM events WHERE epoch(ts) >= 1704110400 AND epoch(ts) < 1704196800)")
def window_union(spark, sf):
    """Two overlapping time ranges read apart and merged; each filter reaches the scan."""
    e = table(spark, sf, "events").select("event_id", "ts")
    part = lambda lo, hi: e.where((F.col("ts") >= F.timestamp_seconds(F.lit(lo))) & (F.col("ts") < F.timestamp_seconds(F.lit(hi)))).select("event_id")
    return part(1704067200, 1704153600).union(part(1704110400, 1704196800)).dropDuplicates(["event_id"])


@query("drop_report", sql("stories", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN p.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'resolved' ELSE 'still' END AS status FROM (SELECT id FROM stories WHERE id % 5 = 0) c FULL JOIN (SELECT id FROM stories WHERE id % 3 = 0) p ON p.id = c.id) GROUP BY status"))
def drop_report(spark, sf):
    """Drops now against those of the run before: new, resolved and still there."""
    s = stories(spark, sf).select("id")
    now, before = s.where("id % 5 = 0"), s.where("id % 3 = 0")
    new, gone = now.join(before, "id", "left_anti"), before.join(now, "id", "left_anti")
    still = now.join(before, "id", "left_semi")
    parts = [d.select(F.lit(n).alias("status")) for d, n in ((new, "new"), (gone, "resolved"), (still, "still"))]
    return reduce(lambda x, y: x.unionAll(y), parts).groupBy("status").agg(F.count("*").alias("n"))


@query("quote_provenance", sql("comments", f"""SELECT c.story_id, c.id, contains({duck_line('c.text')}, {duck_line('x.quote')}) AS accurate FROM comments c
    JOIN (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 THEN 'not there' ELSE '  ' || substr(text, 5, 25) || ' ' END AS quote FROM conversations) x ON x.id = c.id WHERE {duck_line('x.quote')} <> ''"""))
def quote_provenance(spark, sf):
    """Whether a quote is in the comment that it names, blanks collapsed. One equi-join; contains is checked on its rows."""
    quotes = table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS qid", "CASE WHEN turn % 3 = 0 THEN 'not there' ELSE concat('  ', substring(text, 5, 25), ' ') END AS quote")
    rows = comments(spark, sf).join(quotes, F.col("id") == F.col("qid")).withColumn("q", t.single_line(F.col("quote"))).where("q <> ''")
    return rows.select("story_id", "id", t.single_line(F.col("text")).contains(F.col("q")).alias("accurate"))


STEMS = f"list_distinct(list_transform(list_filter({duck_words('x')}, lambda w: length(w) >= 3 AND NOT list_contains([{', '.join(chr(39) + w + chr(39) for w in q.STOP_WORDS)}], w)), lambda w: substr(w, 1, 6)))"
PLAIN = r"regexp_replace(lower(text), '[^\p{L}\p{N}\s\x{00A0}\x{FEFF}]+', ' ', 'g')"


ECHOES = "said AS (SELECT story_id, id, text FROM comments UNION ALL SELECT story_id, id + 500, text || ' Indeed, ' || author FROM comments WHERE pos % 3 = 0)"


@query("containment_pairs", sql("comments", f"""SELECT a.story_id, a.id AS earlier, b.id AS later, round(len(list_intersect(a.st, b.st)) / CAST(least(len(a.st), len(b.st)) AS DOUBLE), 6) AS score FROM stemmed a JOIN stemmed b
    ON a.story_id = b.story_id AND a.id < b.id AND least(len(a.st), len(b.st)) > 0 WHERE len(list_intersect(a.st, b.st)) >= 0.7 * least(len(a.st), len(b.st))""", f"{ECHOES}, plain AS (SELECT story_id, id, {PLAIN} AS x FROM said), stemmed AS (SELECT story_id, id, {STEMS} AS st FROM plain)"))
def containment_pairs(spark, sf):
    """Near-duplicate comments of a story, some of which are said again: stems meet by an equi-join on (story, stem), and shared stems are counted."""
    c = comments(spark, sf)
    echoes = c.where("pos % 3 = 0").select("story_id", F.col("id") + 500, F.concat("text", F.lit(" Indeed, "), "author"))
    s = c.select("story_id", "id", "text").unionAll(echoes).select("story_id", "id", q.stems(F.col("text")).alias("st")).withColumn("n", F.size("st"))
    e = s.select("story_id", "id", "n", F.explode("st").alias("stem"))
    x, y = e.alias("x"), e.alias("y")
    met = x.join(y, (F.col("x.story_id") == F.col("y.story_id")) & (F.col("x.stem") == F.col("y.stem")) & (F.col("x.id") < F.col("y.id")))
    pairs = met.groupBy(F.col("x.story_id").alias("story_id"), F.col("x.id").alias("earlier"), F.col("y.id").alias("later")).agg((F.count("*") / F.first(F.least("x.n", "y.n"))).alias("score"))
    return pairs.where("score >= 0.7").withColumn("score", F.round("score", 6))


@query("near_survivors")
def near_survivors(spark, sf):
    """Comments of a story that repeat neither the first comment nor an earlier survivor; order decides, so no SQL twin."""
    c = comments(spark, sf).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("pos", q.stems(F.col("text")).alias("st")))).alias("c"))
    sets = F.transform("c", lambda x: x["st"])
    return c.select("story_id", F.size("c").alias("n"), F.array_join(q.survivors(sets[0], F.slice(sets, F.lit(2), F.size("c"))).cast("array<string>"), ",").alias("survivors"))


QUERY = "python"


@query("search_exact", sql("stories", f"""SELECT id, round(CASE WHEN contains(lower(title), '{QUERY}') THEN 0.95 + greatest(0.0, 1 - (instr(lower(title), '{QUERY}') - 1) / CAST(length(title) AS DOUBLE) * 0.5) * 0.05 END, 6) AS score FROM stories WHERE contains(lower(title), '{QUERY}')"""))
def search_exact(spark, sf):
    return stories(spark, sf).select("id", F.round(se.exact_score(F.col("title"), QUERY), 6).alias("score")).where("score IS NOT NULL")


@query("search_fuzzy")
def search_fuzzy(spark, sf):
    """Titles by exact or subsequence score; the second runs in Arrow batches, only where the first misses."""
    return stories(spark, sf).select("id", F.round(se.fuzzy_score(F.col("title"), "pthn web"), 6).alias("score")).where("score > 0")


@query("search_tags", sql("story_tags", f"""SELECT story_id, round(s / 2, 6) AS score FROM (SELECT story_id, list_sum([coalesce(list_max(list_transform(tags, lambda x: CASE WHEN lower(x) = 'rust' THEN 1.0 WHEN starts_with(lower(x), 'rust') OR ends_with(lower(x), 'rust') THEN 0.9 WHEN contains(lower(x), 'rust') THEN 0.8 WHEN contains('rust', lower(x)) AND length(x) >= 3 THEN 0.7 ELSE 0.0 END)), 0),
      coalesce(list_max(list_transform(tags, lambda x: CASE WHEN lower(x) = 'data' THEN 1.0 WHEN starts_with(lower(x), 'data') OR ends_with(lower(x), 'data') THEN 0.9 WHEN contains(lower(x), 'data') THEN 0.8 WHEN contains('data', lower(x)) AND length(x) >= 3 THEN 0.7 ELSE 0.0 END)), 0)]) AS s,
      list_contains(list_transform(tags, lambda x: lower(x)), 'rust') AS r, list_has_any(list_transform(tags, lambda x: lower(x)), ['databases']) AS d FROM taglists) WHERE r AND d""", TAG_LIST))
def search_tags(spark, sf):
    tags = a.tag_lists(story_tags(spark, sf))
    return tags.select("story_id", F.round(se.tag_score(F.col("tags"), ["rust", "data"]), 6).alias("score")).where("score IS NOT NULL")


@query("search_rank", sql("stories", f"""SELECT id, round(sc * 4 / 4 + least(0.15, coalesce(score, 0) / 800.0), 6) AS relevance FROM (SELECT *, CASE WHEN contains(lower(title), 'the') THEN 0.95 + greatest(0.0, 1 - (instr(lower(title), 'the') - 1) / CAST(length(title) AS DOUBLE) * 0.5) * 0.05 END AS sc FROM stories)
    WHERE sc IS NOT NULL ORDER BY round((sc + least(0.15, coalesce(score, 0) / 800.0)) / 0.02) DESC, floor(coalesce(score, 0) / 50.0) DESC, {TS} DESC NULLS LAST, id DESC LIMIT 20"""))
def search_rank(spark, sf):
    """The first twenty results for a title query."""
    title = se.exact_score(F.col("title"), "the")
    rows = stories(spark, sf).withColumn("s", title).where("s IS NOT NULL").withColumn("rel", se.relevance(F.col("s"), None, None, F.col("score"))).withColumn("ts", ts())
    return rows.orderBy(*se.result_order(F.lit(True), F.col("rel"), F.col("score"), F.col("ts"), F.col("id"))).limit(20).select("id", F.round("rel", 6).alias("relevance"))


@query("seen_new", sql("comments", "SELECT story_id, id FROM comments WHERE pos = 0 OR id NOT IN (SELECT conv_id * 1000 + turn FROM conversations WHERE turn % 2 = 1)"))
def seen_new(spark, sf):
    """Comments not seen in an earlier run; roots always come."""
    c = comments(spark, sf)
    seen = table(spark, sf, "conversations").where("turn % 2 = 1").selectExpr("conv_id AS story_id", "conv_id * 1000 + turn AS id")
    return c.where("pos > 0").join(seen, ["story_id", "id"], "left_anti").select("story_id", "id").unionAll(c.where("pos = 0").select("story_id", "id"))


@query("recompute_skip", sql("state usage", "SELECT (SELECT max(updated_at) FROM state) AS newest, (SELECT max(created_at) FROM usage) AS last_call, (SELECT max(updated_at) FROM state) = '2024-01-01T00:00:00.000Z' AS skip"))
def recompute_skip(spark, sf):
    """Watermarks of two tables, and whether the first equals the stored one."""
    a_, b_ = state(spark, sf).agg(F.max("updated_at").alias("newest")), usage(spark, sf).agg(F.max("created_at").alias("last_call"))
    return a_.crossJoin(b_).withColumn("skip", F.col("newest") == "2024-01-01T00:00:00.000Z")  # two single rows
