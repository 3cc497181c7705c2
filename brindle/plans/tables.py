"""The engine's relations, derived from the driver tables, each as a DataFrame and as DuckDB SQL.

A query's twin is `sql(relations, body)`: the relations it needs as common tables, then its body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: Registered queries and twins; a query without a twin has no SQL form.
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt out where the scan of a small table has fewer tasks than there are cores: for queries whose work is in each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


TITLES = (
    "Rust c++ news", "c++x and C#9 compared", "A Python (py) web framework", "JS vs TS: the long road", "Postgres and psql at scale",
    "Show: LLMs on a t5", "Large language models with PyTorch", "Go, golang & gRPC", "Next.js or nuxt?", "K8s on AWS with terraform",
    "Ask: is R dead", "Why github actions and ci/cd fail", "OpenAI, Google and Meta", "  Plain title ", "Bitcoin, NFTs, web3", "WASM: web assembly in anger",
)
TAGS = ("rust", "python", "js", "Open AI", "k8s", "Databases", "C++", "web", "llm")


def quoted(items: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in items) + "]"


ISO = "strftime(make_timestamp(CAST({} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"


def iso(seconds: str):
    return F.expr(f"date_format(timestamp_seconds({seconds}), \"yyyy-MM-dd'T'HH:mm:ss'.000Z'\")")


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    url = F.expr(
        """CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN concat('ftp://files.example.org/', doc_id)
        WHEN doc_id % 7 = 0 THEN concat('https://github.com/org/', doc_id)
        WHEN doc_id % 7 = 1 THEN concat('https://www.YouTube.com/watch?x=1&v=vid', doc_id, '&t=3')
        ELSE concat('https://www.', source, '.Example.com/p/', doc_id, '?q=1') END"""
    )
    return d.select(
        F.col("doc_id").alias("id"),
        F.get(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % len(TITLES)).cast("int")).alias("title"),
        url.alias("url"),
        F.col("source").alias("author"),
        (F.lit(1704067200) + F.col("doc_id") * 3571).alias("time"),
        F.when(F.col("doc_id") % 23 == 0, F.lit("soon")).otherwise(iso("1704067200 + doc_id * 3571")).alias("time_iso"),
        F.expr("CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars % 400 END").alias("score"),
        F.expr("CASE WHEN doc_id % 19 = 0 THEN NULL ELSE (doc_id * 37) % 260 END").alias("descendants"),
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lang = F.expr("CASE WHEN doc_id % 29 = 0 THEN 'ru' ELSE 'en' END").alias("lang")
    post = d.where("doc_id % 5 <> 0").select(
        F.col("doc_id").alias("story_id"),
        F.lit("post").alias("kind"),
        lang,
        F.expr("CASE WHEN doc_id % 31 = 0 THEN '  ' ELSE substring(text, 1, cast(100 + doc_id % 900 as int)) END").alias("summary"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 10 <> 1 END").alias("guard_ok"),
    )
    comments = d.where("doc_id % 3 = 0").select(
        F.col("doc_id").alias("story_id"), F.lit("comments").alias("kind"), lang, F.expr("substring(text, 5, 200)").alias("summary"), F.lit(None).cast("boolean").alias("guard_ok")
    )
    return post.unionByName(comments)


def story_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select(F.col("doc_id").alias("story_id"), F.explode(F.expr("sequence(0, cast(doc_id % 4 as int))")).alias("pos")).select(
        "story_id", "pos", F.get(F.array(*map(F.lit, TAGS)), ((F.col("story_id") + F.col("pos") * 2) % len(TAGS)).cast("int")).alias("tag")
    )


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").where("doc_id % 3 <> 1")
    return d.select(
        F.col("doc_id").alias("story_id"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'error' ELSE 'ok' END").alias("post_status"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'ok' END").alias("comments_status"),
        F.lit("ok").alias("tags_status"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN '3' WHEN doc_id % 6 = 0 THEN NULL ELSE '4' END").alias("policy"),
        F.expr("CASE WHEN doc_id % 8 = 0 THEN NULL ELSE concat('h', doc_id % 3) END").alias("input_hash"),
        F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(iso("1704067200 + doc_id * 3571 + (doc_id % 50) * 600")).alias("updated_at"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("story_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.expr("CASE WHEN turn % 5 = 0 THEN conv_id ELSE conv_id * 1000 + turn div 2 END").alias("parent"),
        F.col("turn").alias("pos"),
        F.col("role").alias("author"),
        "text",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("created_at"),
        F.col("user_id").alias("story_id"),
        F.col("event_type").alias("label"),
        F.expr("concat('g', user_id % 3)").alias("gateway"),
        F.expr("concat('m', user_id % 4)").alias("model_requested"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('m', event_id % 2) END").alias("model_used"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 900 END").alias("prompt_tokens"),
        F.expr("CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 70 END").alias("completion_tokens"),
        F.expr("CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END").alias("status"),
    )


#: Further scores of a judge, as SQL that both engines read.
JUDGED = {"accuracy": "1.0 + (doc_id + repeat) % 5", "completeness": "1.0 + (doc_id * 3) % 5", "faithfulness": "2.0 + (doc_id * 7 + repeat) % 4", "format_adherence": "5.0 - doc_id % 2"}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "labels").crossJoin(F.broadcast(spark.range(2).toDF("repeat")))  # two repeats of each
    return base.select(
        F.expr("concat('m/', doc_id % 3)").alias("model"),
        F.col("doc_id").alias("article_id"),
        "repeat",
        F.expr("(doc_id * 131 + repeat * 977) % 5000").alias("latency_ms"),
        F.expr("(doc_id * 17) % 900").alias("output_chars"),
        F.expr("CASE WHEN doc_id % 9 = 0 THEN 'timeout' END").alias("error"),
        F.expr("quality = 1").alias("ok"),
        F.expr("CASE WHEN quality = 1 THEN array() WHEN toxic = 1 THEN array('refusal', 'too_short') ELSE array('too_short') END").cast("array<string>").alias("reasons"),
        F.expr("CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 <> 0 THEN 1.0 + doc_id % 5 END").cast("double").alias("overall"),
        F.expr("CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 <> 0 THEN 5.0 - doc_id % 3 END").cast("double").alias("purity"),
        F.expr("CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 <> 0 THEN toxic = 1 END").alias("refused"),
        *(F.expr(f"CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 <> 0 THEN {e} END").cast("double").alias(c) for c, e in JUDGED.items()),
    )


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired records of two variants over stories and repeats."""
    return table(spark, sf_dir, "labels").select("doc_id").crossJoin(F.broadcast(spark.range(2).toDF("repeat"))).crossJoin(F.broadcast(spark.range(1, 3).toDF("v"))).select(
        F.col("doc_id").alias("story_id"),
        F.expr("CASE WHEN doc_id % 10 = 3 THEN 'edge' ELSE 'quality' END").alias("cohort"),
        "repeat",
        F.expr("concat('v', v)").alias("variant"),
        F.expr("(doc_id + v) % 11 <> 0").alias("validated"),
        F.expr("CASE WHEN (doc_id + repeat) % 13 = 0 THEN NULL ELSE 2.0 + (doc_id * 7 + repeat + v * 3) % 3 + (v - 1) * 0.5 END").cast("double").alias("overall"),
        F.expr("CASE WHEN (doc_id + repeat) % 13 = 0 THEN NULL ELSE 3.0 + (doc_id % 2) END").cast("double").alias("purity"),
        F.expr("(doc_id * 53 + v * 701) % 9000").alias("latency_ms"),
        F.expr("CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END").alias("quote_accurate"),
        F.expr("CASE WHEN (doc_id + repeat) % 13 = 0 THEN NULL ELSE 4.0 + (doc_id + v) % 2 END").cast("double").alias("faithfulness"),
        F.expr("(doc_id + repeat) % 13 <> 0 AND doc_id % 57 = 0 AND v = 1").alias("refused"),
        F.expr("CASE WHEN doc_id % 97 = 0 THEN 429 WHEN doc_id % 101 = 0 THEN 413 ELSE 200 END").alias("http_status"),
    )


RELATIONS = {
    "stories": f"""SELECT doc_id AS id, ({quoted(TITLES)})[doc_id % {len(TITLES)} + 1] AS title,
        CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'ftp://files.example.org/' || doc_id
          WHEN doc_id % 7 = 0 THEN 'https://github.com/org/' || doc_id
          WHEN doc_id % 7 = 1 THEN 'https://www.YouTube.com/watch?x=1&v=vid' || doc_id || '&t=3'
          ELSE 'https://www.' || source || '.Example.com/p/' || doc_id || '?q=1' END AS url,
        source AS author, 1704067200 + doc_id * 3571 AS time,
        CASE WHEN doc_id % 23 = 0 THEN 'soon' ELSE {ISO.format("1704067200 + doc_id * 3571")} END AS time_iso,
        CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars % 400 END AS score,
        CASE WHEN doc_id % 19 = 0 THEN NULL ELSE (doc_id * 37) % 260 END AS descendants FROM documents""",
    "summaries": """SELECT doc_id AS story_id, 'post' AS kind, CASE WHEN doc_id % 29 = 0 THEN 'ru' ELSE 'en' END AS lang,
        CASE WHEN doc_id % 31 = 0 THEN '  ' ELSE substr(text, 1, 100 + doc_id % 900) END AS summary,
        CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 10 <> 1 END AS guard_ok FROM documents WHERE doc_id % 5 <> 0
        UNION ALL SELECT doc_id, 'comments', CASE WHEN doc_id % 29 = 0 THEN 'ru' ELSE 'en' END, substr(text, 5, 200), NULL
        FROM documents WHERE doc_id % 3 = 0""",
    "story_tags": f"""SELECT doc_id AS story_id, pos, ({quoted(TAGS)})[(doc_id + pos * 2) % {len(TAGS)} + 1] AS tag
        FROM documents, generate_series(0, 3) AS g(pos) WHERE pos <= doc_id % 4""",
    "state": f"""SELECT doc_id AS story_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'error' ELSE 'ok' END AS post_status,
        CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'ok' END AS comments_status, 'ok' AS tags_status,
        CASE WHEN doc_id % 5 = 0 THEN '3' WHEN doc_id % 6 = 0 THEN NULL ELSE '4' END AS policy,
        CASE WHEN doc_id % 8 = 0 THEN NULL ELSE 'h' || doc_id % 3 END AS input_hash,
        CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {ISO.format("1704067200 + doc_id * 3571 + (doc_id % 50) * 600")} END AS updated_at
        FROM documents WHERE doc_id % 3 <> 1""",
    "comments": """SELECT conv_id AS story_id, conv_id * 1000 + turn AS id,
        CASE WHEN turn % 5 = 0 THEN conv_id ELSE conv_id * 1000 + turn // 2 END AS parent, turn AS pos, role AS author, text FROM conversations""",
    "usage": """SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at, user_id AS story_id, event_type AS label,
        'g' || user_id % 3 AS gateway, 'm' || user_id % 4 AS model_requested,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'm' || event_id % 2 END AS model_used,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 900 END AS prompt_tokens,
        CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 70 END AS completion_tokens,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status FROM events""",
    "runs": """SELECT 'm/' || doc_id % 3 AS model, doc_id AS article_id, repeat, (doc_id * 131 + repeat * 977) % 5000 AS latency_ms,
        (doc_id * 17) % 900 AS output_chars, CASE WHEN doc_id % 9 = 0 THEN 'timeout' END AS error, quality = 1 AS ok,
        CASE WHEN quality = 1 THEN [] WHEN toxic = 1 THEN ['refusal', 'too_short'] ELSE ['too_short'] END AS reasons,
        CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 <> 0 THEN CAST(1.0 + doc_id % 5 AS DOUBLE) END AS overall,
        CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 <> 0 THEN CAST(5.0 - doc_id % 3 AS DOUBLE) END AS purity,
        CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 <> 0 THEN toxic = 1 END AS refused, """ + ", ".join(f"CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 <> 0 THEN CAST({e} AS DOUBLE) END AS {c}" for c, e in JUDGED.items()) + " FROM labels, generate_series(0, 1) AS g(repeat)",
    "evaluation": """SELECT doc_id AS story_id, CASE WHEN doc_id % 10 = 3 THEN 'edge' ELSE 'quality' END AS cohort, repeat, 'v' || v AS variant,
        (doc_id + v) % 11 <> 0 AS validated,
        CASE WHEN (doc_id + repeat) % 13 = 0 THEN NULL ELSE CAST(2.0 + (doc_id * 7 + repeat + v * 3) % 3 + (v - 1) * 0.5 AS DOUBLE) END AS overall,
        CASE WHEN (doc_id + repeat) % 13 = 0 THEN NULL ELSE CAST(3.0 + (doc_id % 2) AS DOUBLE) END AS purity, (doc_id * 53 + v * 701) % 9000 AS latency_ms,
        CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS quote_accurate,
        CASE WHEN (doc_id + repeat) % 13 = 0 THEN NULL ELSE CAST(4.0 + (doc_id + v) % 2 AS DOUBLE) END AS faithfulness, (doc_id + repeat) % 13 <> 0 AND doc_id % 57 = 0 AND v = 1 AS refused,
        CASE WHEN doc_id % 97 = 0 THEN 429 WHEN doc_id % 101 = 0 THEN 413 ELSE 200 END AS http_status
        FROM labels, generate_series(0, 1) AS g(repeat), generate_series(1, 2) AS h(v)""",
}


def sql(relations: str, body: str, more: str = "") -> str:
    """DuckDB text: WITH the named relations (and further common tables), then the body."""
    tables = [f"{r} AS ({RELATIONS[r]})" for r in relations.split()]
    return "WITH RECURSIVE " + ",\n".join(tables + ([more] if more else [])) + "\n" + body
