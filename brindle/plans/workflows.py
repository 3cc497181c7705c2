"""Selections under caps, attempts and their choice, verdicts that change, reports, and round trips through sources and sinks."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as d
from ..functions import quality as q
from ..functions import search as se
from ..functions import text as t
from ..functions.language_gate import purity
from ..operators import assemble as a
from ..operators import gates as g
from ..operators import state as st
from ..session import shared_folder
from ..sources import readers, sinks
from .collections import CUTOFF, NEEDS, POLICY_OPEN, PUBLISHED, TAG_LIST, TS, collection, in_places, legacy_backlog, ts
from .filters import HOST
from .tables import ORACLES, evaluation, query, spread, sql, state, stories, story_tags, summaries, table
from .texts import DROP_LIST, PROSE, WEIGH, trigger_sql

# Selections


@query("selected_and_legacy", sql("stories state", f"""SELECT id, least(place, 1) AS legacy FROM (SELECT id, min(place) AS place FROM (SELECT s.id, 0 AS place FROM picked s UNION ALL
    SELECT id, row_number() OVER (ORDER BY due, id) FROM (SELECT s.id, coalesce(p.updated_at, s.time_iso, '') AS due FROM stories s LEFT JOIN state p ON p.story_id = s.id
      WHERE s.id % 4 = 0 AND s.id % 2 = 0 AND s.url IS NOT NULL AND trim(s.url) <> '' AND (p.updated_at IS NULL OR p.updated_at < '{CUTOFF}') ORDER BY due, s.id LIMIT 100)) GROUP BY id)
    ORDER BY place, id LIMIT 120""", f"""picked AS (SELECT s.id FROM stories s LEFT JOIN state p ON p.story_id = s.id
    WHERE p.story_id IS NULL OR (({POLICY_OPEN}) AND (p.updated_at IS NULL OR p.updated_at < '{CUTOFF}')) ORDER BY s.descendants ASC NULLS FIRST, s.id DESC LIMIT 60)"""))
def selected_and_legacy(spark, sf):
    """What is selected, sixty at most, and then old extracts that aren't, 120 in all: a cap on a run's work."""
    picked = st.pending(stories(spark, sf).withColumnRenamed("descendants", "rank"), state(spark, sf), "4", CUTOFF, 60).select("id")
    old = legacy_backlog(spark, sf).withColumn("at", F.monotonically_increasing_id())  # at most a hundred, in order
    s, p = stories(spark, sf).select("id", "time_iso"), state(spark, sf).select(F.col("story_id").alias("id"), "updated_at")
    at = F.coalesce("updated_at", "time_iso", F.lit(""))
    rest = old.select("id").join(picked, "id", "left_anti").join(s, "id").join(p, "id", "left").select("id", F.lit(1).alias("legacy"), at.alias("at"))
    both = picked.select("id", F.lit(0).alias("legacy"), F.lit("").alias("at")).unionByName(rest)
    return both.orderBy("legacy", "at", "id").limit(120).select("id", "legacy")


FIXTURES = "SELECT doc_id AS id, n_chars, CASE WHEN n_chars >= 6000 THEN 'long' WHEN n_chars >= 2500 THEN 'medium' ELSE 'short' END AS bucket, doc_id % 3 = 0 AS technical, doc_id % 5 = 0 AS contested FROM documents"
PICKS = (("bucket = 'long'", ("n_chars DESC", "id"), 2), ("bucket = 'medium'", ("technical DESC", "n_chars DESC", "id"), 1), ("bucket = 'medium'", ("contested DESC", "n_chars DESC", "id"), 1), ("bucket = 'short'", ("n_chars", "id"), 2))


@query("fixture_pick", f"WITH f AS ({FIXTURES}), p AS (" + " UNION ALL ".join(f"(SELECT id, {k} * 10 + row_number() OVER (ORDER BY {', '.join(order)}) AS place FROM f WHERE {cond} ORDER BY place LIMIT {n})" for k, (cond, order, n) in enumerate(PICKS)) + """
    UNION ALL (SELECT id, 100 + row_number() OVER (ORDER BY id) FROM f ORDER BY id LIMIT 12))
    SELECT id, row_number() OVER (ORDER BY min(place)) AS place FROM p GROUP BY id ORDER BY min(place) LIMIT 8""")
def fixture_pick(spark, sf):
    """Eight fixtures: two long, a technical and a contested medium one, two short, and by id what is missing."""
    f = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "n_chars", g.size_bucket(F.col("n_chars"), 10000, F.lit(False)).alias("bucket"),
        (F.col("doc_id") % 3 == 0).alias("technical"), (F.col("doc_id") % 5 == 0).alias("contested"),
    )
    order = lambda names: [F.col(n.split()[0]).desc() if n.endswith("DESC") else F.col(n) for n in names]

    def first(rows: DataFrame, names: tuple[str, ...], n: int, base: int) -> DataFrame:
        few = rows.orderBy(*order(names)).limit(n)
        return few.select("id", (F.row_number().over(Window.orderBy(*order(names))) + base).alias("place"))  # n rows

    rows = [first(f.where(cond), names, n, 10 * k) for k, (cond, names, n) in enumerate(PICKS)] + [first(f, ("id",), 12, 100)]
    once = reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.min("place").alias("place")).orderBy("place").limit(8)
    return once.select("id", F.row_number().over(Window.orderBy("place")).alias("place"))


# Attempts. Each document has three drafts: one of a special shape at some ids, a short one, and the whole text.
DRAFTS = """SELECT doc_id * 3 + attempt AS key, CASE WHEN attempt = 2 THEN text WHEN attempt = 1 AND doc_id % 4 <> 1 THEN substr(text, 1, 150 + doc_id % 300) WHEN doc_id % 6 = 0 THEN 'I cannot do it. ' || text
    WHEN doc_id % 6 = 1 THEN 'short' WHEN doc_id % 6 = 2 THEN '{' || substr(text, 1, 400) ELSE substr(text, 1, 80 + doc_id % 500) END AS raw FROM documents, (SELECT unnest([0, 1, 2]) AS attempt)"""
GUARDED = "CASE WHEN key % 7 = 0 THEN NULL ELSE key % 5 <> 0 END"


def drafts(spark, sf):
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "text", F.explode(F.array(*map(F.lit, range(3)))).alias("attempt"))
    raw = F.expr("""CASE WHEN attempt = 2 THEN text WHEN attempt = 1 AND doc_id % 4 <> 1 THEN substring(text, 1, cast(150 + doc_id % 300 as int)) WHEN doc_id % 6 = 0 THEN concat('I cannot do it. ', text)
        WHEN doc_id % 6 = 1 THEN 'short' WHEN doc_id % 6 = 2 THEN concat('{', substring(text, 1, 400)) ELSE substring(text, 1, cast(80 + doc_id % 500 as int)) END""")
    key = F.col("doc_id") * 3 + F.col("attempt")
    return rows.select("doc_id", "attempt", key.alias("key"), q.triggers(raw).alias("reasons"))


@query("first_accepted", "WITH " + trigger_sql(DRAFTS, "key") + f" SELECT key // 3 AS doc_id, min(key % 3) FILTER (len(reasons) = 0 AND coalesce({GUARDED}, true)) AS attempt, count(*) FILTER (len(reasons) > 0) AS flagged FROM found GROUP BY key // 3")
def first_accepted(spark, sf):
    """Up to three attempts at a summary: the first without triggers that the guard doesn't reject (one that is out of service doesn't); null if none does."""
    guard = F.expr(GUARDED)
    fine = (F.size("reasons") == 0) & F.coalesce(guard, F.lit(True))
    return drafts(spark, sf).groupBy("doc_id").agg(F.min(F.when(fine, F.col("attempt").cast("long"))).alias("attempt"), F.count_if(F.size("reasons") > 0).alias("flagged"))


@query("less_severe", "WITH " + trigger_sql(DRAFTS, "key") + f""", s AS (SELECT key // 3 AS doc_id, key % 3 AS attempt, coalesce(list_sum(list_transform(reasons, lambda x: {WEIGH})), 0) AS severity, len(reasons) = 0 AS fine FROM found WHERE key % 3 < 2)
    SELECT a.doc_id, CASE WHEN a.fine THEN 0 WHEN b.fine OR b.severity < a.severity THEN 1 ELSE 0 END AS attempt, CASE WHEN a.fine THEN 0 ELSE least(a.severity, b.severity) END AS severity FROM s a JOIN s b ON b.doc_id = a.doc_id AND a.attempt = 0 AND b.attempt = 1""")
def less_severe(spark, sf):
    """A draft and its retry: the draft if it is fine, else the retry if that is fine or less severe."""
    of = lambda k, c: F.max(F.when(F.col("attempt") == k, c))
    severity = q.rejection_score(F.col("reasons"))
    both = drafts(spark, sf).where("attempt < 2").groupBy("doc_id").agg(of(0, severity).alias("s0"), of(1, severity).alias("s1"), of(0, F.size("reasons") == 0).alias("fine0"), of(1, F.size("reasons") == 0).alias("fine1"))
    retry = ~F.col("fine0") & (F.col("fine1") | (F.col("s1") < F.col("s0")))
    return both.select("doc_id", retry.cast("int").alias("attempt"), F.when(F.col("fine0"), F.lit(0)).otherwise(F.least("s0", "s1")).alias("severity"))


# Verdicts


def article_flags() -> str:
    """The common tables of extract_metrics' twin, with its last rows as `metrics`."""
    body = ORACLES["extract_metrics"]
    head, _, tail = body.rpartition("SELECT doc_id, prose_chars")
    return f"{head.rstrip()}, metrics AS (SELECT doc_id, prose_chars{tail})"


KIND = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'html' WHEN 2 THEN 'reader' ELSE 'pdf' END"


@query("article_verdicts", article_flags() + f""", now AS (SELECT doc_id, {KIND} AS kind, CASE WHEN doc_id % 3 = 0 THEN 'ok' ELSE 'no-article' END AS old, CASE WHEN article THEN 'ok' ELSE 'no-article' END AS verdict FROM metrics)
    SELECT doc_id, CASE WHEN kind IS NULL THEN 'fetch' ELSE verdict END AS verdict FROM now WHERE kind IS NULL OR (kind IN ('html', 'reader') AND verdict <> old)""")
def article_verdicts(spark, sf):
    """What a run changes in cached extracts: verdicts of HTML and reader texts that today's thresholds turn, and old extracts of no known kind, which are fetched again."""
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "text", F.expr(KIND).alias("kind"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'ok' ELSE 'no-article' END").alias("old"))
    verdict = F.when(q.is_article(q.extract_metrics(F.col("text"))), F.lit("ok")).otherwise(F.lit("no-article"))
    judged = rows.where("kind IN ('html', 'reader')").withColumn("verdict", verdict).where("verdict <> old").select("doc_id", "verdict")
    return judged.unionByName(rows.where("kind IS NULL").select("doc_id", F.lit("fetch").alias("verdict")))


@query("language_triggers")
def language_triggers(spark, sf):
    """Triggers of Russian summaries, their language judged by the purity gate."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Проект обсуждает "), "text", F.lit(" и решает precedents сам."))).otherwise(F.expr("repeat('Это длинный русский текст о проекте и его людях. ', 5)"))
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.alias("raw")).withColumn("p", purity(F.col("raw")))
    prose = (F.size("p.runs") > 0) | (F.size("p.singles") > 0)
    return rows.select("doc_id", F.array_join(q.triggers(F.col("raw"), language_flags=(F.col("p.low_ratio"), prose)), ",").alias("reasons"))


RATIOS = (0.5, 0.6, 0.7, 0.8, 0.9)
MIXED = "CASE WHEN doc_id % 3 = 0 THEN text || ' Привет мир `код`' WHEN doc_id % 3 = 1 THEN translate(text, 'abcdefghijklmnopqrs', 'абвгдежзийклмнопрст') ELSE translate(text, 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ') END"


@query("threshold_sweep", f"""WITH p AS (SELECT doc_id, {PROSE.replace("text", "(" + MIXED + ")")} AS x FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(x, '\\p{{Cyrillic}}')) AS a, len(regexp_extract_all(x, '\\p{{Latin}}')) AS b FROM p),
    r AS (SELECT doc_id, CASE WHEN a + b > 0 THEN a / CAST(a + b AS DOUBLE) ELSE 1 END AS ratio FROM c)
    SELECT t AS threshold, count(*) FILTER (ratio < t) AS hits, count(*) FILTER ((ratio < t) = (doc_id % 3 < 2)) AS agreed, count(*) AS n FROM r, (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in RATIOS)}]) AS t) GROUP BY t""")
def threshold_sweep(spark, sf):
    """For candidate thresholds, how many texts fall below, and how many labels agree: one pass over the texts."""
    ratio = q.cyrillic_ratio(F.expr(MIXED))
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", ratio.alias("ratio"), F.explode(F.array(*map(F.lit, RATIOS))).alias("threshold"))
    below = F.col("ratio") < F.col("threshold")
    return rows.groupBy("threshold").agg(F.count_if(below).alias("hits"), F.count_if(below == (F.col("doc_id") % 3 < 2)).alias("agreed"), F.count("*").alias("n"))


# A capture that is cut off: by a cap on calls, or by failures in a row
CALLS, STREAK = 150, 4


@query("capture_run", sql("evaluation", f"""SELECT count(*) AS attempted, count(*) FILTER (ok) AS validated, coalesce(sum(calls), 0)::BIGINT AS calls, CASE WHEN max(streak) >= {STREAK} THEN 'streak' WHEN max(after) >= {CALLS} THEN 'call-cap' ELSE 'complete' END AS stopped,
    percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)::DOUBLE AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)::DOUBLE AS p95 FROM s WHERE after - calls < {CALLS} AND coalesce(max_before, 0) < {STREAK}""", f"""todo AS (SELECT story_id, repeat, validated AND http_status = 200 AS ok, 1 + story_id % 3 AS calls, latency_ms FROM evaluation e WHERE variant = 'v1' AND NOT EXISTS (SELECT 1 FROM evaluation d WHERE d.variant = 'v2' AND d.validated AND d.story_id % 2 = 0 AND d.story_id = e.story_id AND d.repeat = e.repeat)),
    o AS (SELECT *, sum(calls) OVER w AS after, sum(ok::INT) OVER w AS good FROM todo WINDOW w AS (ORDER BY story_id, repeat ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT *, CASE WHEN ok THEN 0 ELSE sum((NOT ok)::INT) OVER (PARTITION BY good ORDER BY story_id, repeat ROWS UNBOUNDED PRECEDING) END AS streak FROM o),
    s AS (SELECT *, max(streak) OVER (ORDER BY story_id, repeat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_before FROM k)"""))
def capture_run(spark, sf):
    """Totals of one run of a resumable capture: what isn't validated yet, in order, until the calls are used up or too many fail in a row.

    Each record takes a call at least, so the first CALLS rows are all that a run can reach; windows are over those.
    """
    e = evaluation(spark, sf)
    done = e.where("variant = 'v2' AND validated AND story_id % 2 = 0").select("story_id", "repeat")
    todo = e.where("variant = 'v1'").join(done, ["story_id", "repeat"], "left_anti").orderBy("story_id", "repeat").limit(CALLS)
    rows = todo.select("story_id", "repeat", (F.col("validated") & (F.col("http_status") == 200)).alias("ok"), (1 + F.col("story_id") % 3).alias("calls"), "latency_ms")
    w = Window.orderBy("story_id", "repeat").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({"after": F.sum("calls").over(w), "good": F.sum(F.col("ok").cast("int")).over(w)})
    since = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("good").orderBy("story_id", "repeat").rowsBetween(Window.unboundedPreceding, 0))
    run = run.withColumn("streak", F.when(F.col("ok"), F.lit(0)).otherwise(since))
    before = F.max("streak").over(Window.orderBy("story_id", "repeat").rowsBetween(Window.unboundedPreceding, -1))
    run = run.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("after") - F.col("calls") < CALLS) & (F.col("before") < STREAK))
    stopped = F.when(F.max("streak") >= STREAK, F.lit("streak")).when(F.max("after") >= CALLS, F.lit("call-cap")).otherwise(F.lit("complete"))
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY latency_ms)")
    return run.agg(F.count("*").alias("attempted"), F.count_if("ok").alias("validated"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), stopped.alias("stopped"), p(0.5).alias("p50"), p(0.95).alias("p95"))


# Search and display
#: Matches after which a search stops, in published order, and results that a page shows.
SCAN, SHOWN = 1500, 1000


def matches(items: DataFrame, title: str, domain: str, tags: list[str]) -> DataFrame:
    """Items that match all parts of a query, with `rel` and `exact`; null scores are no match. items: id, title, domain, tags, score."""
    parts = [("t", se.fuzzy_score(F.col("title"), title) if title else None), ("d", se.fuzzy_score(F.col("domain"), domain) if domain else None), ("g", se.tag_score(F.col("tags"), tags) if tags else None)]
    rows = items
    for name, column in parts:
        if column is not None:
            rows = rows.withColumn(name, column).where(F.col(name) > 0)
    given = {name: F.col(name) if column is not None else None for name, column in parts}
    exact = F.lit(False)
    for c, term in (("title", title), ("domain", domain)):
        exact = exact | (F.coalesce(F.lower(c).contains(term.lower()), F.lit(False)) if term else F.lit(False))
    return rows.withColumn("rel", se.relevance(given["t"], given["d"], given["g"], F.col("score"))).withColumn("exact", exact)


def search_page(items: DataFrame, title: str, domain: str, tags: list[str]) -> DataFrame:
    """The results that a page shows, with their places."""
    first = matches(items, title, domain, tags).orderBy(*a.newest_first(F.col("ts"), F.col("id"))).limit(SCAN)
    order = se.result_order(F.col("exact"), F.col("rel"), F.col("score"), F.col("ts"), F.col("id"))
    best = first.orderBy(*order).limit(SHOWN)
    return best.select("id", F.round("rel", 6).alias("relevance"), "exact", F.row_number().over(Window.orderBy(*order)).alias("place"))  # at most SHOWN rows


def searched(spark, sf):
    s = stories(spark, sf).select("id", "title", t.host(F.col("url")).alias("domain"), "score", ts().alias("ts"))
    return s.join(a.tag_lists(story_tags(spark, sf)), F.col("id") == F.col("story_id"), "left").drop("story_id")


def found_sql(column: str, term: str) -> str:
    return f"CASE WHEN contains(lower({column}), '{term}') THEN 0.95 + greatest(0.0, 1 - (instr(lower({column}), '{term}') - 1) / CAST(length({column}) AS DOUBLE) * 0.5) * 0.05 END"


def tag_sql(term: str) -> str:
    return f"coalesce(list_max(list_transform(tags, lambda x: CASE WHEN lower(x) = '{term}' THEN 1.0 WHEN starts_with(lower(x), '{term}') OR ends_with(lower(x), '{term}') THEN 0.9 WHEN contains(lower(x), '{term}') AND {len(term)} >= 3 THEN 0.8 WHEN contains('{term}', lower(x)) AND length(x) >= 3 THEN 0.7 ELSE 0.0 END)), 0)"


@query("search_full", sql("stories story_tags", f"""SELECT id, round(rel, 6) AS relevance, true AS exact, row_number() OVER (ORDER BY round(rel / 0.02) DESC, floor(coalesce(score, 0) / 50.0) DESC, ts DESC NULLS LAST, id DESC) AS place FROM hits ORDER BY place LIMIT {SHOWN}""", f"""{TAG_LIST},
    parts AS (SELECT id, score, ts, {found_sql('title', 'py')} AS t, {found_sql('domain', 'co')} AS d, {tag_sql('python')} AS g1, {tag_sql('databases')} AS g2, list_contains(list_transform(tags, lambda x: lower(x)), 'python') OR list_contains(list_transform(tags, lambda x: lower(x)), 'databases') AS one FROM (SELECT id, title, {HOST} AS domain, score, {TS} AS ts, tags FROM stories LEFT JOIN taglists ON story_id = id)),
    hits AS (SELECT id, score, ts, (t * 4 + d + (g1 + g2) / 2 * 3) / 8 + least(0.15, coalesce(score, 0) / 800.0) AS rel FROM parts WHERE t IS NOT NULL AND d IS NOT NULL AND g1 > 0 AND g2 > 0 AND (one OR (g1 + g2) / 2 >= 0.8) ORDER BY ts DESC NULLS LAST, id DESC LIMIT {SCAN})"""))
def search_full(spark, sf):
    """A query on title, domain and tags together. Its terms are too short, or too far from all tags, for the loose tiers."""
    return search_page(searched(spark, sf), "py", "co", ["python", "databases"])


@query("search_loose")
def search_loose(spark, sf):
    """A query whose title matches by subsequence only."""
    return search_page(searched(spark, sf), "pythn web", "exampl", [])


@query("human_date", sql("stories", "SELECT id, CASE WHEN id % 29 = 0 THEN '—' WHEN length(time_iso) < 10 THEN time_iso ELSE strftime(strptime(time_iso, '%Y-%m-%dT%H:%M:%S.000Z'), '%B %d, %Y at %I:%M %p') END AS shown FROM stories"))
def human_date(spark, sf):
    return stories(spark, sf).select("id", d.human_date(F.when(F.col("id") % 29 != 0, F.col("time_iso"))).alias("shown"))


# Round trips: written to the shared folder by a sink, read by a source


@query("collection_reread", ORACLES["assemble_publish"])
def collection_reread(spark, sf):
    """The published collection, written and read again."""
    path = shared_folder(spark, "collection")
    from .collections import assemble_publish

    rows = assemble_publish(spark, sf)
    sinks.put(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query("typed_items", sql("stories", "SELECT id, title, url, author, epoch(CASE WHEN id % 5 <> 0 THEN make_timestamp(time * 1000000) END)::BIGINT AS time, score FROM stories WHERE id % 7 <> 3"))
def typed_items(spark, sf):
    """Raw items as JSON documents, some broken, read under their schema: those that don't parse are left out."""
    path = shared_folder(spark, "items")
    s = stories(spark, sf)
    item = F.to_json(F.struct("id", F.lit("story").alias("type"), "title", "url", F.col("author").alias("by"), F.when(F.col("id") % 5 != 0, F.col("time")).alias("time"), "score"))
    s.select(F.when(F.col("id") % 7 == 3, F.substring(item, F.lit(1), F.length(item) - 3)).otherwise(item).alias("value")).write.text(path)
    return readers.json_lenient(spark, path, readers.RAW_ITEM).select("id", "title", "url", F.col("by").alias("author"), "time", "score")


@query("object_store", "SELECT lang, count(*) AS rows FROM documents GROUP BY lang")
def object_store(spark, sf):
    """Batches appended to a folder by language, an empty one among them; its files as objects by key, and their rows."""
    path = shared_folder(spark, "objects")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    for k in range(2):
        sinks.write_archive(docs.where(F.col("doc_id") % 2 == k), path, "lang")
    sinks.append(docs.where("doc_id < -1"), path)
    keys = readers.objects(spark, path, "*.parquet").select(F.regexp_extract("key", "lang=([^/]+)/", 1).alias("lang")).distinct()
    rows = spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("rows"))
    return rows.join(keys, "lang", "left_semi")


@query("manifest_pick", sql("stories", "SELECT pos, id, title FROM (SELECT unnest([9, 4, 100000000, 7]) AS id, unnest([0, 1, 2, 3]) AS pos) JOIN stories USING (id)"))
def manifest_pick(spark, sf):
    """The items that a manifest names, in its order."""
    path = shared_folder(spark, "manifest")
    spark.createDataFrame([(json.dumps({"articleIds": [9, 4, 100_000_000, 7]}),)], "value string").coalesce(1).write.text(path)
    return readers.manifest_items(spark, path, stories(spark, sf).select("id", "title")).select("pos", "id", "title")


@query("ids_of_files", "SELECT DISTINCT doc_id % 10 AS id FROM documents")
def ids_of_files(spark, sf):
    """Ids read off the names of stored files."""
    path = shared_folder(spark, "names")
    table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 10).alias("item")).write.partitionBy("item").parquet(path)
    return readers.ids_in(spark, path, r"/item=([0-9]+)/[^/]*\.parquet$")


@query("point_lookup", sql("stories summaries", f"SELECT s.id, m.summary IS NOT NULL AND length(trim(m.summary)) > 0 AS valid FROM (SELECT doc_id * 3 AS id FROM labels) w JOIN stories s ON s.id = w.id LEFT JOIN summaries m ON m.story_id = s.id AND m.kind = 'post'"))
def point_lookup(spark, sf):
    """Items looked up by key, and whether the part that hangs on them is valid; missing keys give nothing."""
    wanted = table(spark, sf, "labels").select((F.col("doc_id") * 3).alias("id"))
    posts = summaries(spark, sf).where("kind = 'post'").select(F.col("story_id").alias("sid"), "summary")
    rows = wanted.join(stories(spark, sf).select("id"), "id").join(posts, F.col("id") == F.col("sid"), "left")
    return rows.select("id", (F.col("summary").isNotNull() & (F.length(F.trim("summary")) > 0)).alias("valid"))


@query("group_lists", sql(NEEDS, "SELECT strftime(ts, '%Y-%m-%d') AS day, array_to_string(list(id ORDER BY ts DESC, id DESC), ',') AS ids FROM published WHERE ts IS NOT NULL GROUP BY day", PUBLISHED))
def group_lists(spark, sf):
    """A day's ids in the collection's order: a list per key, of one day's items."""
    items = collection(spark, sf).where("ts IS NOT NULL").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "id")
    lists = items.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("ts", "id")), asc=False).alias("x"))
    return lists.select("day", F.array_join(F.transform("x", lambda r: r["id"].cast("string")), ",").alias("ids"))


@query("without_tags", sql("stories story_tags", "SELECT id FROM stories WHERE id NOT IN (SELECT story_id FROM story_tags WHERE pos > 1)"))
def without_tags(spark, sf):
    """Items that lack tags (of the third place on)."""
    return stories(spark, sf).select("id").join(story_tags(spark, sf).where("pos > 1").select(F.col("story_id").alias("id")), "id", "left_anti")


@query("gate_drops", sql("summaries", f"SELECT story_id, list_has_any(reasons, {DROP_LIST}) AS drops FROM found", trigger_sql("SELECT story_id, summary AS raw FROM summaries WHERE kind = 'post'", "story_id")))
def gate_drops(spark, sf):
    return summaries(spark, sf).where("kind = 'post'").select("story_id", q.drops(q.triggers(F.col("summary"))).alias("drops"))
