"""Projections, filters and predicates on stories, comments and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.dates import iso_seconds
from ..functions.quality import rejection_score
from ..operators import gates as g
from .tables import comments, query, runs, sql, stories, summaries, table, usage

NOW = "2024-03-01 00:00:00"
CHARS = "\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def duck_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{CHARS}]+|[{CHARS}]+$', '', 'g')"


def duck_line(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{CHARS}]+', ' ', 'g'))"


def duck_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{CHARS}]+'), lambda w: w <> '')"


GATE = "(coalesce(score, 0) >= 300 OR coalesce(descendants, 0) >= 100)"
HOST = "CASE WHEN regexp_matches(url, '^(?i:https?)://') THEN regexp_replace(lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') END"
ITEM = "https://news.example.org/item?id="


@query("story_normalize", sql("stories", """SELECT id, substr(coalesce(title, '(no title)'), 1, 500) AS title, substr(coalesce(author, 'unknown'), 1, 80) AS author,
    CASE WHEN regexp_matches(url, '^(?i:https?)://[^/?#\\s]+') THEN url END AS url, strftime(make_timestamp(CAST(time AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS time_iso FROM stories"""))
def story_normalize(spark, sf):
    s = stories(spark, sf)
    return s.select("id", t.clamp(F.coalesce("title", F.lit("(no title)")), 500).alias("title"), t.clamp(F.coalesce("author", F.lit("unknown")), 80).alias("author"), t.http_url(F.col("url")).alias("url"), iso_seconds(F.col("time")).alias("time_iso"))


@query("comment_normalize", sql("comments", f"SELECT id, story_id, substr({duck_trim('text')}, 1, 200) AS text FROM comments WHERE {duck_trim('text')} <> ''"))
def comment_normalize(spark, sf):
    c = comments(spark, sf).withColumn("plain", t.trimmed(F.col("text"))).where("plain <> ''")
    return c.select("id", "story_id", t.clamp(F.col("plain"), 200).alias("text"))


@query("gate_engagement", sql("stories", f"SELECT id, {GATE} AS passes, coalesce(score, 0) >= 300 AS by_score, true AS off FROM stories"))
def gate_engagement(spark, sf):
    score, n = F.col("score"), F.col("descendants")
    return stories(spark, sf).select("id", g.passes_gate(score, n).alias("passes"), g.passes_gate(score, n, 300, 0).alias("by_score"), g.passes_gate(score, n, 0, 0).alias("off"))


@query("publish_filter", sql("stories summaries", f"""SELECT s.id, length(m.summary) AS chars FROM stories s JOIN summaries m ON m.story_id = s.id AND m.kind = 'post'
    WHERE {GATE} AND {duck_trim('m.summary')} <> ''"""))
def publish_filter(spark, sf):
    s, m = stories(spark, sf), summaries(spark, sf).where("kind = 'post'")
    both = s.join(m, s.id == m.story_id).where(g.publishable(F.col("summary"), F.col("score"), F.col("descendants")))
    return both.select("id", F.length("summary").cast("long").alias("chars"))


@query("score_floor", sql("stories", "SELECT id, coalesce(score, 0) AS score, coalesce(score, 0) < 50 AS below_cleanup FROM stories WHERE coalesce(score, 0) >= 75 OR coalesce(score, 0) < 50"))
def score_floor(spark, sf):
    z = g.zero(F.col("score"))
    return stories(spark, sf).where((z >= g.AGGREGATE_FLOOR) | (z < g.CLEANUP_FLOOR)).select("id", z.alias("score"), (z < g.CLEANUP_FLOOR).alias("below_cleanup"))


@query("valid_rows", sql("stories", "SELECT id FROM stories WHERE length(title) BETWEEN 1 AND 500 AND regexp_matches(time_iso, '^\\d{4}-\\d{2}-\\d{2}T.*Z$') AND id > 0 AND length(author) BETWEEN 1 AND 80"))
def valid_rows(spark, sf):
    s = stories(spark, sf)
    return s.where(g.valid_item(*(F.col(c) for c in ("id", "title", "author", "time_iso", "url")))).select("id")


@query("domain_extract", sql("stories", f"SELECT id, {HOST} AS domain FROM stories"))
def domain_extract(spark, sf):
    return stories(spark, sf).select("id", t.host(F.col("url")).alias("domain"))


@query("page_domains", f"SELECT page_id, {HOST} AS domain, CASE WHEN regexp_matches(url, '^(?i:https?)://[^/?#\\s]+') THEN url END AS http_url FROM pages")
def page_domains(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.host(F.col("url")).alias("domain"), t.http_url(F.col("url")).alias("http_url"))


@query("item_url", sql("stories", f"SELECT id, '{ITEM}' || id AS item_url FROM stories"))
def item_url(spark, sf):
    return stories(spark, sf).select("id", F.concat(F.lit(ITEM), F.col("id")).alias("item_url"))


@query("badge_flags", sql("stories", "SELECT id, coalesce(descendants > 150, false) AS long, coalesce(score > 250, false) AS hot FROM stories"))
def badge_flags(spark, sf):
    off = F.lit(False)
    return stories(spark, sf).select("id", F.coalesce(F.col("descendants") > g.LONG_DISCUSSION, off).alias("long"), F.coalesce(F.col("score") > g.HOT_SCORE, off).alias("hot"))


@query("cooldown", sql("stories", "SELECT id, coalesce(1709251200 - epoch(try_strptime(time_iso, '%Y-%m-%dT%H:%M:%S.000Z')) < 3000000, false) AS cooling FROM stories"))
def cooldown(spark, sf):
    return stories(spark, sf).select("id", g.in_cooldown(F.col("time_iso"), NOW, 3_000_000).alias("cooling"))


@query("share_bucket", sql("stories", "SELECT id, id % 100 < 30 AS hit, false AS none, true AS every FROM stories"))
def share_bucket(spark, sf):
    i = F.col("id")
    return stories(spark, sf).select("id", g.share_hit(i, 30).alias("hit"), g.share_hit(i, 0).alias("none"), g.share_hit(i, 100).alias("every"))


@query("route_tier", """WITH t AS (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) + 600 AS tokens FROM documents),
    k AS (SELECT *, CASE WHEN doc_id % 100 >= 80 THEN 'legacy' WHEN tokens + 1200 < 2500 THEN CASE WHEN doc_id % 9 = 0 THEN 'skip' ELSE 'short' END WHEN tokens + 1200 <= 4000 THEN 'medium' ELSE 'skip' END AS kind FROM t)
    SELECT doc_id, tokens, kind, CASE kind WHEN 'legacy' THEN 'small' WHEN 'short' THEN 'small' WHEN 'medium' THEN 'medium' ELSE '' END AS model,
    CASE kind WHEN 'legacy' THEN 'share-miss' WHEN 'short' THEN 'under-short-cap' WHEN 'medium' THEN 'under-medium-cap' ELSE CASE WHEN tokens + 1200 < 2500 THEN 'short-exhausted' ELSE 'over-medium-cap' END END AS reason FROM k""")
def route_tier(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))
    spent = F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("small"))).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", "tokens", g.route(F.col("doc_id"), F.col("tokens"), 1200, 80, 2500, 4000, exhausted=spent).alias("r")).select("doc_id", "tokens", "r.*")


@query("substantive", sql("comments", f"""SELECT story_id, count(*) FILTER (length({duck_line('text')}) >= 80) AS substantive,
    CASE WHEN count(*) FILTER (length({duck_line('text')}) >= 80) >= 30 THEN 15 WHEN count(*) FILTER (length({duck_line('text')}) >= 80) >= 20 THEN 12
    WHEN count(*) FILTER (length({duck_line('text')}) >= 80) >= 10 THEN 8 ELSE 5 END AS ceiling FROM comments GROUP BY story_id"""))
def substantive(spark, sf):
    counted = comments(spark, sf).groupBy("story_id").agg(F.count_if(g.is_substantive(F.col("text"))).alias("substantive"))
    return counted.withColumn("ceiling", g.insight_ceiling(F.col("substantive")))


@query("size_bucket", """SELECT doc_id, CASE WHEN doc_id % 40 = 0 OR n_chars >= 6000 THEN 'long' WHEN n_chars >= 2500 THEN 'medium' ELSE 'short' END AS by_chars,
    CASE WHEN doc_id % 60 >= 38 THEN 'long' WHEN doc_id % 60 >= 25 THEN 'medium' WHEN doc_id % 60 >= 3 THEN 'short' END AS by_count FROM documents""")
def size_bucket(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", g.size_bucket(F.col("n_chars"), 10000, i % 40 == 0).alias("by_chars"), g.count_bucket(i % 60).alias("by_count"))


@query("date_range", sql("stories", "SELECT id FROM stories WHERE coalesce(epoch(try_strptime(time_iso, '%Y-%m-%dT%H:%M:%S.000Z')), 0) BETWEEN 1704153600 AND 1704499199"))
def date_range(spark, sf):
    at = F.coalesce(F.unix_timestamp(F.try_to_timestamp("time_iso", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))), F.lit(0))
    return stories(spark, sf).where(at.between(1704153600, 1704499199)).select("id")


@query("compress_state", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR coalesce('h' || doc_id % 2, '') <> 'h1' THEN 'retryable' WHEN doc_id % 5 = 0 THEN 'rejected' ELSE 'usable' END AS state FROM documents""")
def compress_state(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN '' ELSE 'x' END AS body", "concat('h', doc_id % 2) AS hash")
    return d.select("doc_id", g.compressed_state(F.col("body"), F.col("hash"), F.lit("h1")).alias("state"))


@query("guard_normalize", """WITH c AS (SELECT doc_id, quality = 1 AS ok, toxic = 0 AS art, doc_id % 13 = 0 AS refusal, (doc_id % 10) / 10.0 AS conf,
    CASE WHEN doc_id % 4 = 0 THEN 'off_topic' ELSE 'ok' END AS verdict FROM labels),
    f AS (SELECT *, ok AND art AND NOT refusal AND conf >= 0.6 AND NOT (verdict <> 'ok' AND conf >= 0.7) AS fine FROM c)
    SELECT doc_id, fine AS ok, CASE WHEN fine THEN verdict WHEN NOT art THEN 'not_article' WHEN refusal THEN 'refusal' ELSE verdict END AS verdict,
    array_to_string(list_filter([CASE WHEN NOT art THEN 'not_article' END, CASE WHEN refusal THEN 'refusal' END, CASE WHEN doc_id % 2 = 0 THEN 'a' END, 'b', 'c'], lambda x: x IS NOT NULL)[1:2], ',') AS reasons FROM f""")
def guard_normalize(spark, sf):
    c = table(spark, sf, "labels").select(
        "doc_id",
        g.guard_verdict(
            F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 13 == 0, (F.col("doc_id") % 10) / F.lit(10.0),
            F.when(F.col("doc_id") % 4 == 0, F.lit("off_topic")).otherwise(F.lit("ok")),
            F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, (" a", "a ", "", "b", "c")))).otherwise(F.array(F.lit("b"), F.lit("c"))),
        ).alias("v"),
    )
    return c.select("doc_id", "v.ok", "v.verdict", F.array_join("v.reasons", ",").alias("reasons"))


@query("content_sniff", """SELECT page_id, url LIKE '%.pdf' OR page_id % 9 = 0 OR page_id % 10 = 0 AS pdf, page_id % 9 <> 0 AS html FROM pages""")
def content_sniff(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.expr("CASE WHEN page_id % 9 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END").alias("type"), F.expr("CASE WHEN page_id % 10 = 0 THEN '%PDF-1.4' ELSE html END").alias("body"))
    return p.select("page_id", t.looks_like_pdf(F.col("type"), F.col("url"), F.col("body")).alias("pdf"), t.looks_like_html(F.col("type")).alias("html"))


MARKERS = " OR ".join(f"contains(lower(page), '{m}')" for m in t.CHALLENGE_MARKERS)


@query("challenge_detect", f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN html || '<title>Just a Moment' ELSE html END AS page,
    CASE page_id % 4 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 500 END AS status FROM pages)
    SELECT page_id, {MARKERS} AS challenge, coalesce(status = 403, false) OR (coalesce(status = 503, true) AND ({MARKERS})) AS blocked FROM p""")
def challenge_detect(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 6 == 0, F.concat("html", F.lit("<title>Just a Moment"))).otherwise(F.col("html")).alias("page"),
        F.expr("CASE page_id % 4 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 500 END").alias("status"),
    )
    return p.select("page_id", t.is_challenge(F.col("page")).alias("challenge"), t.challenge_error(F.col("status"), F.col("page")).alias("blocked"))


@query("pool_filter", sql("stories comments", "SELECT s.id, s.descendants FROM stories s SEMI JOIN comments c ON c.story_id = s.id WHERE s.descendants >= 3"))
def pool_filter(spark, sf):
    s, c = stories(spark, sf), comments(spark, sf).select(F.col("story_id").alias("id"))
    return s.where("descendants >= 3").join(c, "id", "left_semi").select("id", "descendants")


@query("candidate_lookup", """WITH wanted AS (SELECT DISTINCT l_shipmode AS name FROM (SELECT 'p' || l_linenumber AS l_shipmode FROM lineitem)),
    known(label, model) AS (VALUES ('p1', 'x/one'), ('p2', 'x/two'), ('q', 'p3'))
    SELECT w.name, coalesce(a.model, b.model, w.name) AS model, a.label IS NULL AND b.label IS NULL AS ad_hoc
    FROM wanted w LEFT JOIN known a ON a.label = w.name LEFT JOIN known b ON b.model = w.name""")
def candidate_lookup(spark, sf):
    """Names resolve by label, then by model, else stand for themselves."""
    wanted = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_linenumber").alias("name")).distinct()
    known = spark.createDataFrame([("p1", "x/one"), ("p2", "x/two"), ("q", "p3")], "label string, model string")
    a, b = F.broadcast(known).alias("a"), F.broadcast(known).alias("b")  # a list in code
    both = wanted.join(a, F.col("name") == F.col("a.label"), "left").join(b, F.col("name") == F.col("b.model"), "left")
    return both.select("name", F.coalesce("a.model", "b.model", "name").alias("model"), (F.col("a.label").isNull() & F.col("b.label").isNull()).alias("ad_hoc"))


@query("uniform_usage", sql("usage", "SELECT id, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS total FROM usage WHERE story_id IS NOT NULL"))
def uniform_usage(spark, sf):
    """Ledger rows inside a story, with their token totals."""
    return usage(spark, sf).where("story_id IS NOT NULL").select("id", (g.zero(F.col("prompt_tokens")) + g.zero(F.col("completion_tokens"))).alias("total"))


@query("severity_choice", sql("runs", """SELECT article_id, repeat, list_contains(reasons, 'refusal') AS refused, CASE WHEN len(reasons) = 0 THEN 0 WHEN len(reasons) = 1 THEN 75 ELSE 875 END AS severity FROM runs"""))
def severity_choice(spark, sf):
    return runs(spark, sf).select("article_id", "repeat", F.array_contains("reasons", "refusal").alias("refused"), rejection_score(F.col("reasons")).alias("severity"))
