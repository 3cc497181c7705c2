"""Small operators on answers, bytes, maps and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as mk
from ..functions import quality as q
from ..functions import render as rd
from ..functions import text as t
from ..operators import gates as g
from .filters import duck_trim
from .tables import comments, query, sql, stories, table


@query("decode_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN strlen(text) ELSE length(text) END AS chars, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS sha, CASE WHEN doc_id % 3 = 0 THEN 'latin-1' WHEN doc_id % 3 = 1 THEN 'utf-8' ELSE 'nonsense' END AS charset FROM documents")
def decode_text(spark, sf):
    """Bytes decoded by the charset of their content type, unknown ones as UTF-8."""
    kind = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'text/html; charset=latin-1' WHEN doc_id % 3 = 1 THEN 'text/html' ELSE 'text/plain; charset=nonsense; x' END")
    d = table(spark, sf, "documents").withColumn("kind", kind).withColumn("decoded", mk.decode(F.encode("text", "UTF-8"), F.col("kind")))
    return d.select("doc_id", F.length("decoded").alias("chars"), F.when(F.col("doc_id") % 3 != 0, F.sha2("decoded", 256)).alias("sha"), mk.charset(F.col("kind")).alias("charset"))


@query("strip_fence", f"SELECT doc_id, sha256({duck_trim('text')}) AS body FROM documents WHERE NOT contains(text, '```') UNION ALL SELECT doc_id, NULL FROM documents WHERE contains(text, '```')")
def strip_fence(spark, sf):
    """Answers within a fence or without; an answer that has fences of its own is no answer."""
    fenced = F.col("doc_id") % 2 == 0
    raw = F.concat(F.when(fenced, F.lit(" ```json\n")).otherwise(F.lit("")), "text", F.when(fenced, F.lit("\n``` ")).otherwise(F.lit("\n")))
    return table(spark, sf, "documents").select("doc_id", F.when(~F.col("text").contains("```"), F.sha2(t.strip_json_fence(raw), 256)).alias("body"))


@query("clean_output", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'no end to this paragraph that ' || doc_id || ' goes…' ELSE 'All of ' || doc_id || ' is well.' END AS text FROM documents")
def clean_output(spark, sf):
    """Answers without fences, quotes and labels, ends repaired."""
    i = F.col("doc_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit("```text\n\"Итог: All of\n "), i, F.lit(" is  well.\"\n```"))).when(i % 3 == 1, F.concat(F.lit(" «**Итоговый текст**: All of "), i, F.lit(" is well.» "))).otherwise(
        F.concat(F.lit("no end to this paragraph that "), i, F.lit(" goes onw"))
    )
    return table(spark, sf, "documents").select("doc_id", t.clean_model_output(raw).alias("text"))


@query("compressed_verdict", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'empty' WHEN doc_id % 4 = 1 THEN 'too_short' WHEN doc_id % 4 = 2 THEN 'expanded' ELSE 'refusal' END AS verdict FROM documents")
def compressed_verdict(spark, sf):
    i, long = F.col("doc_id"), F.expr("repeat('word other ', 30)")
    text = F.when(i % 4 == 0, F.lit(" ")).when(i % 4 == 1, F.lit("short")).when(i % 4 == 2, long).otherwise(F.concat(long, F.lit("as an ai")))
    source = F.when(i % 4 == 2, F.lit("x")).otherwise(F.expr("repeat('word other ', 90)"))
    return table(spark, sf, "documents").select("doc_id", q.compressed_verdict(text, source).alias("verdict"))


RAGGED = "replace(replace(text, '. ', '.     ' || chr(10)), '```', '')"


@query("tidy_text", f"""SELECT doc_id, sha256({duck_trim("regexp_replace(" + RAGGED + " || chr(10), '[ \\t]{3,}\\n', '  ' || chr(10), 'g') || '```' || chr(10) || " + RAGGED + " || chr(10) || '```'")}) AS text FROM documents""")
def tidy_text(spark, sf):
    """More than two trailing blanks become two, but not within fences."""
    ragged = F.replace(F.replace("text", F.lit(". "), F.lit(".     \n")), F.lit("```"), F.lit(""))
    raw = F.concat(ragged, F.lit("\n```\n"), ragged, F.lit("\n```"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(mk.batched(mk.tidy_model_text, "string", raw), 256).alias("text"))


@query("site_base", sql("stories", "SELECT id, CASE WHEN id % 3 = 0 THEN 'https://site.example.org' WHEN id % 3 = 1 THEN 'https://other.example.org/a' ELSE 'https://site.example.org' END AS base FROM stories"))
def site_base(spark, sf):
    """A configured base without its last slash, or the default where it is unsafe."""
    raw = F.expr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'https://other.example.org/a/' ELSE 'https://me:secret1@x.org' END")
    base = F.coalesce(t.safe_http_url(raw), F.lit("https://site.example.org"))
    return stories(spark, sf).select("id", F.regexp_replace(base, "/$", "").alias("base"))


@query("histogram_map", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def histogram_map(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("histogram"))


@query("merge_seen", """SELECT conv_id, count(DISTINCT turn) AS seen FROM (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn FROM conversations WHERE turn < 3) GROUP BY conv_id""")
def merge_seen(spark, sf):
    """Two runs' maps of ids by depth, merged key by key."""
    c = table(spark, sf, "conversations").withColumn("depth", F.col("turn") % 3)

    def by_depth(rows, name):
        ids = rows.groupBy("conv_id", "depth").agg(F.collect_set("turn").alias("ids"))
        return ids.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("depth", "ids"))).alias(name))

    none = F.create_map().cast("map<bigint,array<bigint>>")
    both = by_depth(c.where("turn % 2 = 0"), "a").join(by_depth(c.where("turn < 3"), "b"), "conv_id", "full")
    empty = F.array().cast("array<bigint>")
    merged = F.map_zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda k, x, y: F.array_union(F.coalesce(x, empty), F.coalesce(y, empty)))
    return both.select("conv_id", F.size(F.flatten(F.map_values(merged))).cast("long").alias("seen"))


@query("insight_candidates")
def insight_candidates(spark, sf):
    """Insights of each thread held to the ceiling, the heuristics and the least length of the card they make."""
    c = comments(spark, sf).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"), F.count_if(g.is_substantive(F.col("text"))).alias("s"))
    insights = F.slice(F.transform("c", lambda x: F.struct(F.lit("consensus").alias("kind"), x["text"].alias("text"))), F.lit(1), g.insight_ceiling(F.col("s")))
    rows = c.select("story_id", insights.alias("i")).withColumn("line", F.col("i")[0]["text"])
    found = q.insight_triggers(rd.insights_text(F.col("line"), F.col("i")))
    card = rd.card(rd.parts(F.col("line"), F.col("i"), F.lit(None).cast("string")))
    verdict = F.when(F.size(found) > 0, F.array_join(found, ",")).when(F.length(t.trimmed(card)) < 200, F.lit("too_short")).otherwise(F.lit("ok"))
    return rows.select("story_id", F.size("i").alias("insights"), verdict.alias("verdict"))


SPACED = "replace(text, '. ', '.' || repeat(chr(10), cast(2 + doc_id % 5 as int)))"


@query("pdf_pages", f"SELECT doc_id, sha256(trim(regexp_replace({SPACED}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'))) AS sha FROM documents")
def pdf_pages(spark, sf):
    """Texts as a PDF gives them: nulls between sentences, and many line ends."""
    spaced = F.expr(SPACED.replace("||", "||").replace("chr(10)", "'\\n'"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(mk.pdf_text(F.concat(F.lit("\u0000"), spaced)), 256).alias("sha"))
