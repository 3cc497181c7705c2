"""Aggregations, windows, thread trees and evaluation statistics."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import render as rd
from ..functions import text as t
from ..operators import gates as g
from ..operators import stats
from ..operators import threads as th
from .filters import duck_line
from .tables import comments, evaluation, query, runs, sql, stories, table, usage

ROLLUP = """SELECT substr(created_at, 1, 10) AS day, gateway, label, model_requested, model_used, count(*) AS calls, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors,
    sum(coalesce(prompt_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(completion_tokens, 0))::BIGINT AS completion_tokens, sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))::BIGINT AS total_tokens
    FROM usage GROUP BY ALL"""


def rollup(spark, sf):
    u = usage(spark, sf).withColumn("day", F.substring("created_at", 1, 10))
    p, c = g.zero(F.col("prompt_tokens")), g.zero(F.col("completion_tokens"))
    return u.groupBy("day", "gateway", "label", "model_requested", "model_used").agg(
        F.count("*").alias("calls"), F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors"), F.sum(p).alias("prompt_tokens"), F.sum(c).alias("completion_tokens"), F.sum(p + c).alias("total_tokens")
    )


@query("usage_rollup", sql("usage", ROLLUP))
def usage_rollup(spark, sf):
    """Calls and tokens per day, gateway, label and models; an unknown model is a group."""
    return rollup(spark, sf)


@query("usage_totals", sql("usage", f"SELECT count(*) AS groups, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, sum(total_tokens)::BIGINT AS tokens FROM ({ROLLUP})"))
def usage_totals(spark, sf):
    r = rollup(spark, sf)
    return r.agg(F.count("*").alias("groups"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("total_tokens").alias("tokens"))


@query("usage_top", sql("usage", f"SELECT day, gateway, label, total_tokens FROM ({ROLLUP}) ORDER BY day DESC, total_tokens DESC, gateway, label, model_requested, model_used NULLS FIRST LIMIT 30"))
def usage_top(spark, sf):
    """The first thirty lines of the usage report."""
    return rollup(spark, sf).orderBy(F.desc("day"), F.desc("total_tokens"), "gateway", "label", "model_requested", F.col("model_used").asc_nulls_first()).limit(30).select("day", "gateway", "label", "total_tokens")


@query("watermarks", sql("usage", "SELECT label, max(created_at) AS newest, min(created_at) AS oldest FROM usage GROUP BY label"))
def watermarks(spark, sf):
    return usage(spark, sf).groupBy("label").agg(F.max("created_at").alias("newest"), F.min("created_at").alias("oldest"))


@query("daily_top_n", "SELECT day, event_id, n - 1 AS rank FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY value DESC NULLS LAST, ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def daily_top_n(spark, sf):
    """The ten best of every day; ranks above ten are dropped before the shuffle by the window's group limit."""
    w = Window.partitionBy("day").orderBy(F.col("value").desc_nulls_last(), F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "value", "ts")
    return e.withColumn("n", F.row_number().over(w)).where("n <= 10").select("day", "event_id", (F.col("n") - 1).alias("rank"))


@query("orders_daily_top", "SELECT day, o_orderkey, n - 1 AS rank FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m-%d') ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def orders_daily_top(spark, sf):
    w = Window.partitionBy("day").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey"))
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_totalprice")
    return o.withColumn("n", F.row_number().over(w)).where("n <= 3").select("day", "o_orderkey", (F.col("n") - 1).alias("rank"))


@query("list_ranks", "SELECT doc_id, pos - 1 AS rank, id FROM (SELECT doc_id, unnest([doc_id * 2, doc_id + 1, 7]) AS id, unnest([1, 2, 3]) AS pos FROM labels)")
def list_ranks(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.posexplode(F.expr("array(doc_id * 2, doc_id + 1, 7L)")).alias("rank", "id"))


@query("leaderboard", sql("runs", """SELECT model, count(*) AS n, round(avg(ok::INT), 6) AS pass_rate, round(avg((coalesce(refused, false) OR list_contains(reasons, 'refusal'))::INT), 6) AS refusal_rate,
    round(avg((error IS NOT NULL)::INT), 6) AS error_rate, """ + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in stats.JUDGED) + """, percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)::DOUBLE AS p50,
    percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)::DOUBLE AS p95, round(avg(output_chars), 6) AS mean_chars, round(coalesce(avg(overall), 0) * avg(ok::INT), 6) AS composite FROM runs GROUP BY model"""))
def leaderboard(spark, sf):
    board = stats.leaderboard(runs(spark, sf))
    return board.select(*(F.round(c, 6).alias(c) if k == "double" and c not in ("p50", "p95") else F.col(c) for c, k in board.dtypes))


@query("failure_histogram", sql("runs", "SELECT model, reason, count(*) AS n FROM (SELECT model, unnest(CASE WHEN error IS NOT NULL THEN list_append(reasons, 'candidate_error') ELSE reasons END) AS reason FROM runs) GROUP BY ALL"))
def failure_histogram(spark, sf):
    return stats.failures(runs(spark, sf))


PAIRS = """pairs AS (SELECT story_id, repeat, max(overall) FILTER (variant = 'v1') AS a, max(overall) FILTER (variant = 'v2') AS b FROM evaluation WHERE cohort <> 'edge' GROUP BY ALL),
    deltas AS (SELECT story_id, avg(b - a) AS delta FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY story_id)"""


@query("paired_delta", sql("evaluation", "SELECT story_id, round(delta, 6) AS delta FROM deltas", PAIRS))
def paired_delta(spark, sf):
    return stats.story_deltas(evaluation(spark, sf)).withColumn("delta", F.round("delta", 6))


CHECKS = [
    ("quality_thread_count", "threads >= 20"), ("overall_delta", "delta >= 0.3"), ("validation_pass_rate_v2", "pass_rate >= 0.9"), ("missing_results", "missing <= 0"),
    ("language_purity_v2", "purity >= 4.5"), ("faithfulness_v2", "faith >= 4"), ("faithfulness_delta", "faith - faith_v1 >= 0"),
    ("quote_accuracy_on_emitted_v2", "quote_accuracy IS NULL OR quote_accuracy >= 1"), ("refusals_v2", "refusals <= 0"),
]


def gate_row(e):
    """One row of an evaluation's measures. Means are over judged records, the difference over stories' means of pairs, threads over distinct stories."""
    q = e.where("cohort <> 'edge'")
    of = lambda v, c: F.avg(F.when(F.col("variant") == v, F.col(c).cast("double")))
    row = q.agg(
        F.countDistinct("story_id").alias("threads"), of("v2", "validated").alias("pass_rate"), F.count_if(F.col("overall").isNull()).alias("missing"),
        of("v2", "purity").alias("purity"), of("v2", "faithfulness").alias("faith"), of("v1", "faithfulness").alias("faith_v1"),
        of("v2", "quote_accurate").alias("quote_accuracy"), F.count_if((F.col("variant") == "v2") & F.col("refused")).alias("refusals"),
    )
    return row.crossJoin(stats.story_deltas(e).agg(F.avg("delta").alias("delta")))  # two single rows


@query("release_gate", sql("evaluation", " UNION ALL ".join(f"SELECT '{n}' AS \"check\", coalesce({c}, false) AS passed FROM totals" for n, c in CHECKS), PAIRS + """,
    totals AS (SELECT count(DISTINCT story_id) AS threads, (SELECT avg(delta) FROM deltas) AS delta, avg(validated::INT) FILTER (variant = 'v2') AS pass_rate, count(*) FILTER (overall IS NULL) AS missing,
      avg(purity) FILTER (variant = 'v2') AS purity, avg(faithfulness) FILTER (variant = 'v2') AS faith, avg(faithfulness) FILTER (variant = 'v1') AS faith_v1,
      avg(quote_accurate::INT) FILTER (variant = 'v2') AS quote_accuracy, count(*) FILTER (variant = 'v2' AND refused) AS refusals FROM evaluation WHERE cohort <> 'edge')"""))
def release_gate(spark, sf):
    """Nine of the ten checks; the tenth needs the seeded generator (release_gate_full)."""
    return stats.gate_checks(gate_row(evaluation(spark, sf)), CHECKS)


def bootstrap_of(e) -> tuple[int, float | None]:
    return stats.bootstrap_bound(stats.story_deltas(e), 1)


@query("release_gate_full")
def release_gate_full(spark, sf):
    """All ten checks, in order."""
    e = evaluation(spark, sf)
    row = gate_row(e).withColumn("lower", F.lit(bootstrap_of(e)[1]).cast("double"))
    return stats.gate_checks(row, [*CHECKS[:2], ("bootstrap_95_lower", "lower > 0"), *CHECKS[2:]])


@query("bootstrap_bound")
def bootstrap_bound(spark, sf):
    """Lower bound of the mean paired difference, resampled with the seeded generator."""
    return spark.createDataFrame([bootstrap_of(evaluation(spark, sf))], "n int, lower double")


CANDIDATE = [
    ("validated", "n - validated <= greatest(1, round(n / 12))"), ("provenance_failures", "provenance = 0"), ("http_413", "h413 = 0"), ("http_429_burst", "h429 < 2"), ("p95_latency_ms", "p95 <= 8000"),
]


@query("candidate_gate", sql("evaluation", " UNION ALL ".join(f"SELECT variant, '{n}' AS \"check\", coalesce({c}, false) AS passed FROM totals" for n, c in CANDIDATE), """totals AS (SELECT variant, count(*) AS n, count(*) FILTER (validated) AS validated,
    count(*) FILTER (quote_accurate = false) AS provenance, count(*) FILTER (http_status = 413) AS h413, count(*) FILTER (http_status = 429) AS h429,
    list_sort(list(latency_ms) FILTER (http_status = 200))[1 + CAST(floor(0.95 * (count(*) FILTER (http_status = 200) - 1)) AS INT)] AS p95 FROM evaluation GROUP BY variant)"""))
def candidate_gate(spark, sf):
    """Five checks of each route. Latencies are of calls that went through; their percentile takes the value at floor(0.95 (n - 1))."""
    e = evaluation(spark, sf)
    p95 = stats.floor_rank(e.where("http_status = 200"), ["variant"], "latency_ms", 0.95).withColumnRenamed("value", "p95")
    rows = e.groupBy("variant").agg(
        F.count("*").alias("n"), F.count_if("validated").alias("validated"), F.count_if(F.col("quote_accurate") == F.lit(False)).alias("provenance"),
        F.count_if(F.col("http_status") == 413).alias("h413"), F.count_if(F.col("http_status") == 429).alias("h429"),
    )
    return stats.gate_checks(rows.join(p95, "variant", "left"), CANDIDATE, ["variant"])


QUANTILES = (0.0, 0.05, 0.1, 0.5, 0.9, 1.0)


@query("quantiles", "SELECT lang, " + ", ".join(f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY n_chars), 6) AS q{int(p * 100)}" for p in QUANTILES) + ", count(*) FILTER (n_chars < 500) AS below FROM documents GROUP BY lang")
def quantiles(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(*(F.round(stats.linear("n_chars", p), 6).alias(f"q{int(p * 100)}") for p in QUANTILES), F.count_if(F.col("n_chars") < 500).alias("below"))


@query("top_share", "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT n_chars AS threshold FROM r WHERE i = least(n - 1, CAST(floor(0.65 * n) AS BIGINT))")
def top_share(spark, sf):
    """The value that the top 35 % reach: of the sorted values the one at floor(0.65 n), by counts of values instead of a sort of rows."""
    v = table(spark, sf, "documents").groupBy("n_chars").agg(F.count("*").alias("c"))
    run = v.withColumn("upto", F.sum("c").over(Window.orderBy("n_chars"))).crossJoin(v.agg(F.sum("c").alias("n")))  # one row per distinct value
    return run.where(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(0.65) * F.col("n")))).agg(F.min("n_chars").alias("threshold"))


TECH = ("api", "cache", "thread", "query", "hash", "p99", "index", "the", "that")
CONTEST = ("however", "but", "actually", "not", "on the other hand", "la", "is")


@query("density_scores", sql("comments", f"""SELECT story_id, round(sum(len(regexp_extract_all(text, '(?i)\\b(?:{"|".join(TECH)})\\b')) + 2 * len(regexp_extract_all(text, '(?i)https?://\\S+')) + len(regexp_extract_all(text, '[0-9]+'))) / count(*), 6) AS technical,
    round((sum(len(regexp_extract_all(text, '(?i)\\b(?:{"|".join(CONTEST)})\\b'))) + 0.5 * count(*) FILTER (parent <> story_id)) / count(*), 6) AS contested FROM comments GROUP BY story_id"""))
def density_scores(spark, sf):
    """Terms, links and numbers, and marks of dissent, per comment."""
    c = lambda p: F.regexp_count("text", F.lit(p))
    tech = F.sum(c(t.bounded(list(TECH))) + 2 * c(r"(?i)https?://\S+") + c("[0-9]+")) / F.count("*")
    contest = (F.sum(c(t.bounded(list(CONTEST)))) + 0.5 * F.count_if(F.col("parent") != F.col("story_id"))) / F.count("*")
    return comments(spark, sf).groupBy("story_id").agg(F.round(tech, 6).alias("technical"), F.round(contest, 6).alias("contested"))


@query("probe_result", sql("runs", "SELECT model, count(*) AS attempts, CASE WHEN count(*) FILTER (error IS NULL) = count(*) THEN 'pass' ELSE 'fail_' || count(*) FILTER (error IS NOT NULL) || '_of_' || count(*) END AS result, round(avg(latency_ms))::BIGINT AS mean_ms FROM runs GROUP BY model"))
def probe_result(spark, sf):
    n, bad = F.count("*"), F.count_if(F.col("error").isNotNull())
    return runs(spark, sf).groupBy("model").agg(n.alias("attempts"), F.when(bad == 0, F.lit("pass")).otherwise(F.concat(F.lit("fail_"), bad, F.lit("_of_"), n)).alias("result"), F.round(F.avg("latency_ms")).cast("long").alias("mean_ms"))


@query("task_grid", "SELECT m AS model, doc_id AS article_id, r AS repeat FROM labels, (SELECT unnest(['a', 'b', 'c']) AS m), generate_series(1, 3) AS g(r)")
def task_grid(spark, sf):
    """Every model on every article, three times: arrays exploded in place, no join."""
    return table(spark, sf, "labels").select(F.explode(F.array(*map(F.lit, "abc"))).alias("model"), F.col("doc_id").alias("article_id")).select("model", "article_id", F.explode(F.expr("sequence(1L, 3L)")).alias("repeat"))


@query("prefix_budget", sql("comments", "SELECT story_id, id FROM (SELECT *, sum(length(text) + 2) OVER (PARTITION BY story_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM comments) WHERE used <= 3000"))
def prefix_budget(spark, sf):
    used = F.sum(F.length("text") + 2).over(Window.partitionBy("story_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return comments(spark, sf).withColumn("used", used).where("used <= 3000").select("story_id", "id")


@query("greedy_pack", sql("comments", """SELECT story_id, pos FROM fold WHERE taken""", """fold AS (
    SELECT story_id, pos, least(length(text), 2000)::BIGINT AS used, true AS taken, true AS started FROM comments WHERE pos = 0 UNION ALL
    SELECT c.story_id, c.pos, CASE WHEN f.used + length(c.text) + 2 <= 2500 THEN f.used + length(c.text) + 2 ELSE f.used END, f.used + length(c.text) + 2 <= 2500, true
    FROM fold f JOIN comments c ON c.story_id = f.story_id AND c.pos = f.pos + 1)"""))
def greedy_pack(spark, sf):
    """Comments of a story in order, each taken if it still fits; the first always (cut to 2000)."""
    c = comments(spark, sf).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.length("text").cast("long").alias("n")))).alias("c"))
    lengths = F.transform("c", lambda x, i: F.when(i == 0, F.least(x["n"], F.lit(2000))).otherwise(x["n"]))
    return c.select("story_id", F.explode(th.packed(lengths, 2500)).alias("at"), "c").select("story_id", F.expr("c[at - 1].pos").alias("pos"))


@query("token_window", sql("usage", "SELECT id, sum(coalesce(prompt_tokens, 0)) OVER (PARTITION BY gateway ORDER BY epoch(strptime(created_at, '%Y-%m-%dT%H:%M:%S.000Z')) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)::BIGINT AS used FROM usage"))
def token_window(spark, sf):
    """Tokens of a gateway in the sixty seconds up to each call. Hours are windows of their own, so that a busy gateway is dealt
    out; a call of an hour's last minute also counts, without a row, in the next one's."""
    at, hour = F.unix_timestamp(F.to_timestamp("created_at")), F.floor(F.col("at") / 3600)
    hours = F.when(F.col("at") % 3600 >= 3540, F.array(hour, hour + 1)).otherwise(F.array(hour))
    calls = usage(spark, sf).withColumn("at", at).select("id", "gateway", "at", g.zero(F.col("prompt_tokens")).alias("tokens"), F.posexplode(hours).alias("copy", "hour"))
    w = Window.partitionBy("gateway", "hour").orderBy("at").rangeBetween(-60, 0)
    return calls.withColumn("used", F.sum("tokens").over(w)).where("copy = 0").select("id", "used")


@query("stratified_pick", """WITH b AS (SELECT doc_id, CASE WHEN n_chars >= 6000 THEN 'long' WHEN n_chars >= 2500 THEN 'medium' ELSE 'short' END AS bucket FROM documents)
    SELECT doc_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS n FROM b) WHERE n <= 2""")
def stratified_pick(spark, sf):
    b = table(spark, sf, "documents").select("doc_id", g.size_bucket(F.col("n_chars"), 10000, F.lit(False)).alias("bucket"))
    return b.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id"))).where("n <= 2").drop("n")


@query("quota_select")
def quota_select(spark, sf):
    """Twenty threads by several quotas at once: each pick goes to what most quotas still want.

    Threads of one bucket and language, or a language without quota, differ by their ids alone, so the first twenty of each will do.
    """
    want = {"long": 5, "medium": 5, "short": 4, "en": 5, "fr": 3}
    bucket, lang = g.size_bucket(F.col("n_chars"), 20000, F.lit(False)).alias("bucket"), F.when(F.col("lang").isin("en", "fr"), F.col("lang")).alias("lang")
    place = F.row_number().over(Window.partitionBy("bucket", "lang").orderBy("doc_id"))
    top = table(spark, sf, "documents").select("doc_id", lang, bucket).withColumn("n", place).where("n <= 20").drop("n").collect()
    chosen, left = [], list(top)
    while left and len(chosen) < 20:
        best = max(left, key=lambda r: (sum(want.get(x, 0) > 0 for x in (r.bucket, r.lang)), -r.doc_id))
        for x in (best.bucket, best.lang):
            want[x] = want.get(x, 0) - 1
        chosen.append((len(chosen), best.doc_id, best.bucket))
        left.remove(best)
    return spark.createDataFrame(chosen, "place int, doc_id long, bucket string")


@query("digest_hash")
def digest_hash(spark, sf):
    """Hash of an ordered digest's ids and titles, per day."""
    rows = stories(spark, sf).where("length(time_iso) > 10").groupBy(F.substring("time_iso", 1, 10).alias("day")).agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("x"))
    return rows.select("day", F.sha2(F.to_json(F.struct(F.transform("x", lambda r: r["id"]).alias("ids"), F.transform("x", lambda r: r["title"]).alias("titles"))), 256).alias("digest"))


@query("distinct_lists", "SELECT conv_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS roles FROM (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def distinct_lists(spark, sf):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(roles), ",").alias("roles"))


@query("event_histogram", "SELECT user_id % 5 AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_histogram(spark, sf):
    return table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("language_regions", """SELECT r_name, n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY ALL""")
def language_regions(spark, sf):
    """A star join: facts by key, dimensions as the optimizer likes."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, sf, "orders").where("o_orderdate >= TIMESTAMP '1994-01-01'").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


NODES = f"""nodes AS (SELECT * FROM (SELECT story_id, id, parent, pos, author, {duck_line('text')} AS text, row_number() OVER (PARTITION BY story_id, id ORDER BY pos) AS n FROM comments WHERE {duck_line('text')} <> '') WHERE n = 1),
    linked AS (SELECT a.story_id, a.id, a.pos, a.text, a.author, b.id AS parent_id FROM nodes a LEFT JOIN nodes b ON b.story_id = a.story_id AND b.id = a.parent AND a.parent <> a.story_id)"""
TREE = NODES + """, tree AS (SELECT story_id, id, id AS root, 0 AS depth FROM linked WHERE parent_id IS NULL UNION ALL SELECT l.story_id, l.id, t.root, t.depth + 1 FROM tree t JOIN linked l ON l.story_id = t.story_id AND l.parent_id = t.id),
    sizes AS (SELECT story_id, root, count(*) AS size FROM tree GROUP BY ALL)"""


@query("thread_parents", sql("comments", "SELECT story_id, id, parent_id FROM linked", NODES))
def thread_parents(spark, sf):
    return th.parent_links(comments(spark, sf)).select("story_id", "id", "parent_id")


@query("subtree_sizes", sql("comments", "SELECT story_id, root, size FROM sizes", TREE))
def subtree_sizes(spark, sf):
    return th.branch_table(th.parent_links(comments(spark, sf))).groupBy("story_id", "root").agg(F.count("*").alias("size"))


@query("branch_rank", sql("comments", "SELECT s.story_id, s.root, s.size, row_number() OVER (PARTITION BY s.story_id ORDER BY s.size DESC, l.pos) - 1 AS rank FROM sizes s JOIN linked l ON l.story_id = s.story_id AND l.id = s.root", TREE))
def branch_rank(spark, sf):
    return th.branch_table(th.parent_links(comments(spark, sf))).where("id = root").select("story_id", "root", "size", "rank")


@query("tree_depths", sql("comments", "SELECT story_id, id, root, depth FROM tree", TREE))
def tree_depths(spark, sf):
    return th.branch_table(th.parent_links(comments(spark, sf))).select("story_id", "id", "root", "depth")


@query("thread_render")
def thread_render(spark, sf):
    """Whole branches of every thread within 6000 characters, rendered; skipping depends on order, so no SQL twin."""
    out = th.render_threads(th.parent_links(comments(spark, sf)), 6000)
    return out.select("story_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"), F.size("included").alias("included"), F.size("dropped").alias("dropped"))


@query("bounded_crawl")
def bounded_crawl(spark, sf):
    """Breadth-first crawl of every thread: four levels, thirty comments."""
    return th.crawl(comments(spark, sf), 4, 30)


@query("baseline_report", sql("runs", """SELECT model, repeat, count(*) AS n, count(*) FILTER (error IS NULL) AS fine, list_sort(list(latency_ms))[1 + CAST(floor(0.5 * (count(*) - 1)) AS INT)] AS p50, list_sort(list(latency_ms))[1 + CAST(floor(0.95 * (count(*) - 1)) AS INT)] AS p95 FROM runs GROUP BY ALL"""))
def baseline_report(spark, sf):
    r, keys = runs(spark, sf), ["model", "repeat"]
    report = r.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("fine"))
    for p in (50, 95):
        report = report.join(stats.floor_rank(r, keys, "latency_ms", p / 100).withColumnRenamed("value", f"p{p}"), keys, "left")
    return report


@query("blind_pairs", sql("evaluation", "SELECT story_id, repeat, max(overall) FILTER (variant = 'v1') AS v1, max(overall) FILTER (variant = 'v2') AS v2, count(*) FILTER (overall IS NULL) AS missing FROM evaluation GROUP BY ALL"))
def blind_pairs(spark, sf):
    of = lambda v: F.max(F.when(F.col("variant") == v, F.col("overall"))).alias(v)
    return evaluation(spark, sf).groupBy("story_id", "repeat").agg(of("v1"), of("v2"), F.count_if(F.col("overall").isNull()).alias("missing"))


def canonical_sql() -> str:
    return f"""SELECT story_id, count(*) AS included, max(used)::BIGINT AS chars FROM (SELECT story_id, length('[story id=' || story_id || ']' || chr(10) || 'comments:') +
    sum(2 + length('[comment id=' || id || ' parent=' || parent || ' by=' || author || ']') + 1 + length({duck_line('text')})) OVER (PARTITION BY story_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM comments) WHERE used <= 3000 GROUP BY story_id"""


@query("canonical_thread", sql("comments", canonical_sql()))
def canonical_thread(spark, sf):
    """How much of each thread, comment by comment in order, fits a prompt of 3000 characters."""
    head = F.length(F.concat(F.lit("[story id="), "story_id", F.lit("]\ncomments:")))
    block = F.length(F.concat(F.lit("[comment id="), "id", F.lit(" parent="), "parent", F.lit(" by="), t.single_line(F.col("author")), F.lit("]\n"), t.single_line(F.col("text")))) + 2
    used = head + F.sum(block).over(Window.partitionBy("story_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return comments(spark, sf).withColumn("used", used).where("used <= 3000").groupBy("story_id").agg(F.count("*").alias("included"), F.max("used").alias("chars"))


def threads_as_arrays(spark, sf):
    c = comments(spark, sf).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "author", "text"))).alias("c"))
    return c.where(F.size("c") > 1)


@query("render_cards")
def render_cards(spark, sf):
    """Cards whose bottom line is a thread's first comment, whose insights are the others and whose quote is the second."""
    kinds = F.array(*map(F.lit, ("consensus", "dispute", "advice")))
    insights = F.transform(F.slice(F.col("c"), F.lit(2), F.size("c")), lambda x: F.struct(F.get(kinds, (x["pos"] % 3).cast("int")).alias("kind"), F.substring(x["text"], 1, 200).alias("text")))
    quoted = rd.quote(F.col("c")[1]["text"], F.col("c")[1]["author"], F.lit(None).cast("string"))
    rows = threads_as_arrays(spark, sf).withColumn("p", rd.parts(F.substring(F.col("c")[0]["text"], 1, 300), insights, quoted))
    return rows.select("story_id", F.length(rd.card(F.col("p"))).alias("chars"), F.sha2(rd.card(F.col("p")), 256).alias("sha"), rd.fold_label(F.col("p")).alias("label"))


@query("fallback_cards")
def fallback_cards(spark, sf):
    card = rd.fallback_card(F.col("c"))
    return threads_as_arrays(spark, sf).select("story_id", F.length(card).alias("chars"), F.sha2(card, 256).alias("sha"))


@query("compress_hash", sql("comments", f"""SELECT story_id, sha256(string_agg(CASE WHEN pos = 0 THEN '' WHEN pos % 3 = 1 THEN 'Спор: ' WHEN pos % 3 = 2 THEN 'Совет: ' ELSE '' END || x, chr(10) ORDER BY pos)) AS hash
    FROM (SELECT story_id, pos, {duck_line("text")} AS x FROM comments) WHERE pos = 0 OR x <> '' GROUP BY story_id HAVING count(*) > 1"""))
def compress_hash(spark, sf):
    """Hash of a compression's input: bottom line and insights as plain text."""
    kinds = F.array(*map(F.lit, ("consensus", "dispute", "advice")))
    insights = F.transform(F.slice(F.col("c"), F.lit(2), F.size("c")), lambda x: F.struct(F.get(kinds, (x["pos"] % 3).cast("int")).alias("kind"), t.single_line(x["text"]).alias("text")))
    return threads_as_arrays(spark, sf).select("story_id", F.sha2(rd.insights_text(t.single_line(F.col("c")[0]["text"]), insights), 256).alias("hash"))
