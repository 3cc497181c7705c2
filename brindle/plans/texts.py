"""Scalar functions on texts, dates and tags; quality triggers and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as d
from ..functions import quality as q
from ..functions import tags as tg
from ..functions import text as t
from ..functions.language_gate import purity
from .filters import CHARS, HOST, duck_line, duck_trim, duck_words
from .tables import RELATIONS, TAGS, query, quoted, spread, sql, stories, story_tags, summaries, table


def phrases(text: str, items: tuple[str, ...], pad: str = "") -> str:
    return "(" + " OR ".join(f"contains({text}, '{pad}" + p.replace("'", "''") + f"{pad}')" for p in items) + ")"


def trigger_sql(source: str, key: str) -> str:
    """Common tables r1.. and the final one, `found(key, reasons)`, of the triggers of source(key, raw) for posts."""
    strong, weak = phrases("padded", q.INSTRUCTION_STRONG, " "), " + ".join(f"CAST(contains(padded, ' {p} ') AS INT)" for p in q.INSTRUCTION_WEAK)
    sentence = f"len(list_filter(regexp_split_to_array(low, '[\\n!.;?]+'), lambda x: {phrases('x', q.APOLOGY)} AND {phrases('x', q.INABILITY)})) > 0"
    rules = [
        ("length(s) < 120", "too_short"), ("n < 25", "too_few_words"), ("len(list_filter(lines, lambda x: NOT starts_with(ltrim(x), '- '))) = 0", "bullets_only"),
        (phrases("low", q.REFUSAL), "refusal"), (sentence, "refusal"), (phrases("low", q.POLICY), "policy"), (phrases("low", q.GENERIC), "generic"),
        (phrases("low", q.META), "meta_instructions"), (phrases("low", q.CONTENT_FREE), "content_free"), ("contains(s, '<|')", "artifact"), ("contains(s, '```')", "artifact"),
        ("starts_with(s, '{') OR starts_with(s, '[')", "artifact"), ("contains(low, 'http://') OR contains(low, 'https://')", "contains_url"),
        ("n >= 20 AND list_max(list_transform(range(1, n + 1), lambda i: CASE WHEN i + 7 <= n AND len(list_distinct(w[i:i+7])) = 1 THEN 1 ELSE 0 END)) = 1", "repetition_run"),
        ("n >= 80 AND len(list_distinct(w)) / CAST(n AS DOUBLE) < 0.2", "low_unique_ratio"), ("pct >= 8 AND pct / CAST(length(s) AS DOUBLE) >= 0.05", "url_encoded_noise"),
        ("bare >= 10 AND bare / CAST(len(lines) AS DOUBLE) >= 0.9", "bare_bullets"), (f"(CASE WHEN {strong} THEN 2 ELSE 0 END) + ({weak}) >= 2", "prompt_instructions"),
        ("heads >= 3 AND full_lines > 0 AND heads / CAST(full_lines AS DOUBLE) >= 0.8", "numeric_headings"),
    ]
    cases = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in rules)
    return f"""r1 AS (SELECT {key}, raw, {duck_trim('raw')} AS s FROM ({source})),
    r2 AS (SELECT *, lower(s) AS low, list_transform({duck_words('s')}, lambda x: lower(x)) AS w, regexp_split_to_array(s, '\\r?\\n') AS lines FROM r1),
    r3 AS (SELECT *, len(w) AS n, len(regexp_extract_all(s, '(?i)%[0-9a-f]{{2}}')) AS pct, ' ' || {duck_line("regexp_replace(low, '[^" + CHARS + "\\p{L}\\p{N}]', ' ', 'g')")} || ' ' AS padded,
      len(list_filter(lines, lambda x: regexp_matches({duck_trim('x')}, '^\\\\?[-–—•]{{1,4}}$'))) AS bare, len(list_filter(lines, lambda x: {duck_trim('x')} <> '')) AS full_lines,
      len(list_filter(lines, lambda x: regexp_matches({duck_trim('x')}, '^#+\\s*[0-9./\\- \\t]*[0-9][0-9./\\- \\t]*$'))) AS heads FROM r2),
    found AS (SELECT {key}, CASE WHEN raw IS NULL OR s = '' THEN ['empty'] ELSE list_filter([{cases}], lambda x: x IS NOT NULL) END AS reasons FROM r3)"""


POSTS = "SELECT story_id, summary AS raw, guard_ok FROM summaries WHERE kind = 'post'"
DOCS = "SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN NULL WHEN doc_id % 50 = 8 THEN ' ' WHEN doc_id % 50 = 9 THEN repeat('- point ' || chr(10), 12) WHEN doc_id % 50 = 10 THEN 'I am sorry, but i cannot do it. See https://x.org' WHEN doc_id % 50 = 11 THEN repeat('same ', 30) WHEN doc_id % 50 = 12 THEN repeat('%D0%9F', 9) WHEN doc_id % 50 = 13 THEN repeat('-' || chr(10), 12) WHEN doc_id % 50 = 14 THEN 'Твоя задача: you must summarize <| this' WHEN doc_id % 50 = 15 THEN '# 1.2' || chr(10) || '## 3' || chr(10) || '# 4-5' WHEN doc_id % 50 = 16 THEN '{{\"a\":1}} ``` guidelines' ELSE text END AS raw FROM documents".replace("{{", "{").replace("}}", "}")


def shaped(spark, sf):
    """documents, with texts of special shapes at some ids."""
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.expr(
            """CASE WHEN doc_id % 50 = 7 THEN NULL WHEN doc_id % 50 = 8 THEN ' ' WHEN doc_id % 50 = 9 THEN repeat('- point \\n', 12)
            WHEN doc_id % 50 = 10 THEN 'I am sorry, but i cannot do it. See https://x.org' WHEN doc_id % 50 = 11 THEN repeat('same ', 30)
            WHEN doc_id % 50 = 12 THEN repeat('%D0%9F', 9) WHEN doc_id % 50 = 13 THEN repeat('-\\n', 12)
            WHEN doc_id % 50 = 14 THEN 'Твоя задача: you must summarize <| this' WHEN doc_id % 50 = 15 THEN '# 1.2\\n## 3\\n# 4-5'
            WHEN doc_id % 50 = 16 THEN '{"a":1} ``` guidelines' ELSE text END"""
        ).alias("raw"),
    )


@query("summary_triggers", "WITH " + trigger_sql(DOCS, "doc_id") + " SELECT doc_id, array_to_string(reasons, ',') AS reasons FROM found")
def summary_triggers(spark, sf):
    return shaped(spark, sf).select("doc_id", F.array_join(q.triggers(F.col("raw")), ",").alias("reasons"))


@query("trigger_histogram", "WITH " + trigger_sql(DOCS, "doc_id") + ", x AS (SELECT doc_id, unnest(reasons) AS reason FROM found) SELECT reason, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x GROUP BY reason")
def trigger_histogram(spark, sf):
    found = shaped(spark, sf).select("doc_id", F.explode(q.triggers(F.col("raw"))).alias("reason"))
    return found.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


DROP_LIST = "[" + ", ".join(f"'{r}'" for r in q.DROP) + "]"
WEIGH = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in q.WEIGHTS.items()) + " ELSE 100 END"


@query("sanitize_summary", sql("summaries", f"""SELECT story_id, CASE WHEN g.guard_ok = false THEN 'guard' WHEN list_has_any(reasons, {DROP_LIST}) THEN 'heuristics' ELSE 'kept' END AS stage
    FROM found JOIN (SELECT story_id, guard_ok FROM summaries WHERE kind = 'post') g USING (story_id)""", trigger_sql("SELECT story_id, summary AS raw FROM summaries WHERE kind = 'post'", "story_id")))
def sanitize_summary(spark, sf):
    m = summaries(spark, sf).where("kind = 'post'")
    stage = F.when(F.col("guard_ok") == F.lit(False), F.lit("guard")).when(q.drops(q.triggers(F.col("summary"))), F.lit("heuristics")).otherwise(F.lit("kept"))
    return m.select("story_id", stage.alias("stage"))


@query("rejection_score", "WITH " + trigger_sql(DOCS, "doc_id") + f" SELECT doc_id, coalesce(list_sum(list_transform(reasons, lambda x: {WEIGH})), 0) AS severity FROM found")
def rejection_score(spark, sf):
    return shaped(spark, sf).select("doc_id", q.rejection_score(q.triggers(F.col("raw"))).alias("severity"))


PROSE = "regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^\\n\\r`]*`', ' ', 'g')"


@query("cyrillic_ratio", f"""WITH p AS (SELECT doc_id, {PROSE.replace("text", "(CASE WHEN doc_id % 3 = 0 THEN text || ' Привет мир `код`' ELSE text END)")} AS x FROM documents),
    c AS (SELECT doc_id, len(regexp_extract_all(x, '\\p{{Cyrillic}}')) AS a, len(regexp_extract_all(x, '\\p{{Latin}}')) AS b FROM p)
    SELECT doc_id, round(CASE WHEN a + b > 0 THEN a / CAST(a + b AS DOUBLE) ELSE 1 END, 6) AS ratio FROM c""")
def cyrillic_ratio(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Привет мир `код`"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.round(q.cyrillic_ratio(text), 6).alias("ratio"))


INSIGHTS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' As an AI' WHEN 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ') ELSE text END AS raw FROM documents"
OF_INSIGHTS = "[" + ", ".join(f"'{r}'" for r in q.INSIGHT_REASONS) + "]"


@query("insight_triggers", "WITH " + trigger_sql(INSIGHTS, "doc_id") + f""", c AS (SELECT doc_id, len(regexp_extract_all(x, '\\p{{Cyrillic}}')) AS a, len(regexp_extract_all(x, '\\p{{Latin}}')) AS b FROM (SELECT doc_id, {PROSE.replace("text", "raw")} AS x FROM ({INSIGHTS})))
    SELECT doc_id, array_to_string(list_concat(list_filter(reasons, lambda x: list_contains({OF_INSIGHTS}, x)), CASE WHEN a + b > 0 AND a / CAST(a + b AS DOUBLE) < 0.65 THEN ['low_cyrillic_ratio'] ELSE [] END), ',') AS reasons FROM found JOIN c USING (doc_id)""")
def insight_triggers(spark, sf):
    d_ = spread(table(spark, sf, "documents").select("doc_id", "text"))
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(text, ' As an AI') WHEN 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ') ELSE text END")
    return d_.select("doc_id", F.array_join(q.insight_triggers(text, 0.65), ",").alias("reasons"))


NO_SPACE = q.NO_SPACE
COUNT = f"(len({duck_words('x')}) + CAST(ceil(len(regexp_extract_all(x, '{NO_SPACE}')) / 2.0) AS INT))"


@query("extract_metrics", f"""WITH a AS (SELECT doc_id, text AS md, list_filter(list_transform(string_split(text, chr(10)), lambda x: {duck_trim('x')}), lambda x: x <> '') AS lines FROM documents),
    b AS (SELECT *, list_transform(lines, lambda x: {COUNT}) AS counts,
      list_filter(list_transform(regexp_extract_all(regexp_replace(md, '(?m)^#.*$', ' ', 'g'), '[^.!?…\\n]+[.!?…]+'), lambda x: {duck_trim('x')}), lambda x: len({duck_words('x')}) >= 5) AS phrases FROM a),
    c AS (SELECT *, coalesce(list_sum(counts), 0) AS total, len(string_split(md, '](')) - 1 AS links,
      coalesce(list_sum(list_transform(lines, lambda x, i: CASE WHEN counts[i] >= 12 AND NOT regexp_matches(x, '^[#>|]') THEN length(x) + 2 * len(regexp_extract_all(x, '{NO_SPACE}')) ELSE 0 END)), 0) AS prose FROM b),
    e AS (SELECT doc_id, prose AS prose_chars, CASE WHEN total > 0 THEN links / CAST(total AS DOUBLE) WHEN links > 0 THEN 1 ELSE 0 END AS ld,
      CASE WHEN len(lines) > 0 THEN 1 - len(list_distinct(lines)) / CAST(len(lines) AS DOUBLE) ELSE 0 END AS dr,
      CASE WHEN len(phrases) > 0 THEN 1 - len(list_distinct(phrases)) / CAST(len(phrases) AS DOUBLE) ELSE 0 END AS pr, total AS word_count, len(lines) AS n_lines FROM c)
    SELECT doc_id, prose_chars, round(ld, 6) AS link_density, round(dr, 6) AS dup_ratio, round(pr, 6) AS phrase_dup_ratio, word_count, n_lines,
      prose_chars >= 500 AND ld <= 0.5 AND dr <= 0.5 AND pr <= 0.5 AS article FROM e""")
def extract_metrics(spark, sf):
    m = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", q.extract_metrics(F.col("text")).alias("m"))
    ratios = [F.round(f"m.{c}", 6).alias(c) for c in ("link_density", "dup_ratio", "phrase_dup_ratio")]
    return m.select("doc_id", "m.prose_chars", *ratios, "m.word_count", F.col("m.lines").alias("n_lines"), q.is_article(F.col("m")).alias("article"))


@query("longest_word_run", f"""WITH w AS (SELECT doc_id, list_transform({duck_words("repeat('go ', doc_id % 5) || text")}, lambda x: lower(x)) AS w FROM documents),
    u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT doc_id, x, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS grp FROM u),
    c AS (SELECT doc_id, x, grp, count(*) AS n FROM g GROUP BY ALL) SELECT doc_id, max(n) AS run FROM c GROUP BY doc_id""")
def longest_word_run(spark, sf):
    text = F.concat(F.expr("repeat('go ', cast(doc_id % 5 as int))"), "text")
    return table(spark, sf, "documents").select("doc_id", q.longest_run(F.transform(t.words(text), F.lower)).cast("long").alias("run"))


@query("latin_runs")
def latin_runs(spark, sf):
    """Language purity of Russian texts with English in them: findings depend on neighbouring tokens."""
    text = F.concat(F.lit("Проект обсуждает "), "text", F.lit(" и решает precedents сам."))
    p = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", purity(text).alias("p"))
    return p.select("doc_id", F.round("p.cyrillic_ratio", 6).alias("ratio"), "p.low_ratio", F.size("p.runs").alias("runs"), F.array_join("p.singles", ",").alias("singles"))


@query("slugify", f"""WITH n AS (SELECT id, title, (({quoted(TAGS)}))[id % {len(TAGS)} + 1] || ' Don’t “C++/CLI” & .NET' AS name FROM stories),
    s AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower({duck_trim('name')}), '[''’]', '', 'g'), '[^0-9#+\\-.a-z]+', '-', 'g'), '-+', '-', 'g') AS x FROM n)
    SELECT id, regexp_replace(x, '^-|-$', '', 'g') AS slug FROM s""".replace("WITH n", "WITH stories AS (" + RELATIONS["stories"] + "), n", 1))
def slugify(spark, sf):
    name = F.concat(F.get(F.array(*map(F.lit, TAGS)), (F.col("id") % len(TAGS)).cast("int")), F.lit(" Don’t “C++/CLI” & .NET"))
    return stories(spark, sf).select("id", t.slugify(name).alias("slug"))


def duck_slug(x: str) -> str:
    inner = f"regexp_replace(regexp_replace(regexp_replace(lower({duck_trim(x)}), '[''’]', '', 'g'), '[^0-9#+\\-.a-z]+', '-', 'g'), '-+', '-', 'g')"
    return f"regexp_replace({inner}, '^-|-$', '', 'g')"


ALIAS = "CASE lower({0}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tg.ALIASES.items()) + " ELSE {0} END"


@query("canonical_tags", sql("story_tags", f"SELECT story_id, pos, {duck_slug('(' + ALIAS.format('tag') + ')')} AS slug FROM story_tags"))
def canonical_tags(spark, sf):
    return story_tags(spark, sf).select("story_id", "pos", tg.canonical(F.col("tag")).alias("slug"))


TITLE_CASES = ", ".join("CASE WHEN regexp_matches(title, '(?i)\\b(?:" + "|".join(forms) + f")\\b') THEN '{tag}' END" for tag, forms in tg.TITLE_RULES)
DOMAIN_CASES = ", ".join("CASE WHEN " + " OR ".join(f"contains(domain, '{p}')" for p in parts.split("|")) + f" THEN '{tag}' END" for parts, tag in tg.DOMAINS)
TAG_TABLES = f"""hosts AS (SELECT id, title, coalesce({HOST}, '') AS domain FROM stories),
    every AS (SELECT id, list_filter([{DOMAIN_CASES}, {TITLE_CASES}], lambda x: x IS NOT NULL) AS a FROM hosts),
    heur AS (SELECT id, list_filter(a, lambda x, i: list_position(a, x) = i)[1:12] AS a FROM every)"""


@query("heuristic_tags", sql("stories", "SELECT id, array_to_string(a, ',') AS tags FROM heur", TAG_TABLES))
def heuristic_tags(spark, sf):
    s = stories(spark, sf).select("id", "title", t.host(F.col("url")).alias("domain"))
    return s.select("id", F.array_join(tg.heuristic_tags(F.col("title"), F.col("domain")), ",").alias("tags"))


@query("combine_tags", sql("stories story_tags", "SELECT id, array_to_string(list_filter(b, lambda x, i: list_position(b, x) = i)[1:10], ',') AS tags FROM joined", TAG_TABLES + f""",
    given AS (SELECT story_id, list({duck_slug('(' + ALIAS.format('tag') + ')')} ORDER BY pos) AS g FROM story_tags GROUP BY story_id),
    joined AS (SELECT id, list_concat(g, a) AS b FROM heur JOIN given ON story_id = id)"""))
def combine_tags(spark, sf):
    given = story_tags(spark, sf).groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("given"))
    s = stories(spark, sf).select("id", "title", t.host(F.col("url")).alias("domain")).join(given, F.col("id") == F.col("story_id"))
    return s.select("id", F.array_join(tg.combined_tags(F.col("given"), F.col("title"), F.col("domain")), ",").alias("tags"))


@query("tag_kinds", "SELECT l_linenumber AS n, CASE l_linenumber WHEN 1 THEN 'lang' WHEN 2 THEN 'lib' WHEN 3 THEN 'topic' WHEN 5 THEN 'infra' END AS kind FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def tag_kinds(spark, sf):
    raw = F.get(F.array(*map(F.lit, (" Programming Language", "libraries", "Concept", "color", "infra", "x", "y"))), F.col("l_linenumber") - 1)
    return table(spark, sf, "lineitem").select("l_linenumber").distinct().select(F.col("l_linenumber").alias("n"), tg.kind(raw).alias("kind"))


@query("escape_text", """SELECT doc_id, sha256(html) AS html, sha256(markdown) AS markdown FROM (SELECT doc_id, replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
    regexp_replace(x, '([\\\\`*_\\[\\]{}<>#+\\-|!])', '\\\\\\1', 'g') AS markdown FROM (SELECT doc_id, '<a href="#x">it''s & [b]_' || text AS x FROM documents))""")
def escape_text(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("<a href=\"#x\">it's & [b]_"), F.col("text")).alias("x"))
    return x.select("doc_id", F.sha2(t.escape_html(F.col("x")), 256).alias("html"), F.sha2(t.escape_markdown(F.col("x")), 256).alias("markdown"))


@query("head_tail", "SELECT doc_id, CASE WHEN length(text) <= 900 THEN sha256(text) ELSE sha256(substr(text, 1, 600) || chr(10) || chr(10) || '[…]' || chr(10) || chr(10) || right(text, 200)) END AS slice_hash FROM documents")
def head_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(t.head_tail(F.col("text"), 900, 600, 200), 256).alias("slice_hash"))


@query("single_line", f"SELECT doc_id, sha256({duck_line('text')}) AS line FROM documents")
def single_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(t.single_line(F.col("text")), 256).alias("line"))


def duck_rtrim(x: str) -> str:
    return f"regexp_replace({x}, '[{CHARS}]+$', '')"


@query("clamp_display", f"""WITH a AS (SELECT doc_id, {duck_rtrim('text')} AS x FROM documents), b AS (SELECT doc_id, x, substr(x, 1, 300) AS cut, {duck_rtrim("regexp_extract(substr(x, 1, 300), '(?s)^(.*) ', 1)")} AS sp FROM a)
    SELECT doc_id, CASE WHEN length(x) <= 300 THEN x WHEN length(sp) >= 20 THEN sp || '…' ELSE {duck_rtrim('cut')} || '…' END AS shown FROM b""")
def clamp_display(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.clamp_display(F.col("text"), 300).alias("shown"))


@query("clamp_clause", f"""WITH a AS (SELECT doc_id, {duck_rtrim('substr(text, 1, 40 + doc_id % 200)')} AS x FROM documents),
    b AS (SELECT *, regexp_extract(x, '(?s)^(.*[.!?…]["''»”)\\]]*)', 1) AS sen, {duck_rtrim("regexp_replace(x, '\\s+\\S*$', '')")} AS wo FROM a)
    SELECT doc_id, CASE WHEN x = '' OR regexp_matches(x, '[.!?…]["''»”)\\]]*$') THEN x WHEN length(sen) >= 20 THEN sen WHEN length(wo) >= 20 THEN wo || '…' ELSE x || '…' END AS clause FROM b""")
def clamp_clause(spark, sf):
    cut = F.expr("substring(text, 1, cast(40 + doc_id % 200 as int))")
    return table(spark, sf, "documents").select("doc_id", t.clamp_clause(cut).alias("clause"))


@query("video_id", sql("stories", "SELECT id, CASE WHEN id % 7 = 1 AND id % 11 <> 0 AND id % 13 <> 0 THEN 'vid' || id END AS video FROM stories"))
def video_id(spark, sf):
    return stories(spark, sf).select("id", t.video_id(F.col("url")).alias("video"))


@query("safe_url", sql("stories", "SELECT id, CASE WHEN regexp_matches(url, '^(?i:https?)://') THEN url END AS safe FROM stories"))
def safe_url(spark, sf):
    return stories(spark, sf).select("id", t.safe_http_url(F.col("url")).alias("safe"))


@query("text_hash", "SELECT doc_id, sha256(text) AS sha, sha256(concat_ws('|', lang, '4', text)) AS input_hash FROM documents")
def text_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.sha2(F.concat_ws("|", "lang", F.lit("4"), "text"), 256).alias("input_hash"))


SAID = "regexp_replace(text, '[<>\"\\\\]', ' ', 'g')"
LINES = f"list_filter(string_split({SAID}, chr(10)), lambda x: {duck_trim('x')} <> '' AND NOT regexp_matches(x, '^[0-9]+$'))"


@query("vtt_captions", f"""SELECT doc_id, sha256({duck_line("'hello world ' || doc_id || '. ' || array_to_string(" + LINES + ", ' ')")}) AS caption, sha256({duck_line("'a ' || " + SAID)}) AS xml, sha256({duck_line("'one ' || " + SAID + " || 'two'")}) AS json FROM documents""")
def vtt_captions(spark, sf):
    """Captions of each format that say whole texts, a cue after a short one."""
    said = F.regexp_replace("text", '[<>"\\\\]', " ")
    vtt = F.concat(F.lit("WEBVTT\n\n1\n00:01 --> 00:02\nhello  world\n\n2\n00:02 --> 00:03\n "), F.col("doc_id"), F.lit(". \n \n"), said, F.lit("\n"))
    xml = F.concat(F.lit('<t><text start="1">a</text><text>'), said, F.lit("</text></t>"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.lit("one\n").alias("utf8"))).alias("segs")), F.struct(F.lit(None).cast("array<struct<utf8:string>>").alias("segs")), F.struct(F.array(F.struct(said.alias("utf8")), F.struct(F.lit("two").alias("utf8"))).alias("segs"))).alias("events")))
    return table(spark, sf, "documents").select("doc_id", *(F.sha2(x, 256).alias(c) for c, x in (("caption", t.vtt_text(vtt)), ("xml", t.caption_xml_text(xml)), ("json", t.caption_json_text(body)))))


@query("track_choice", """WITH tracks AS (SELECT conv_id, turn, ['de', 'en-US', 'fr', 'en'][(conv_id + turn) % 4 + 1] AS lang, CASE WHEN turn % 2 = 0 THEN 'asr' END AS kind FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN lang = 'en' THEN 0 WHEN starts_with(lang, 'en') THEN 1 WHEN kind IS DISTINCT FROM 'asr' THEN 2 ELSE 3 END, turn) AS n FROM tracks)
    SELECT conv_id, turn, lang FROM r WHERE n = 1""")
def track_choice(spark, sf):
    """The caption track: exact language, then its prefix, then one not made by a machine, then the first."""
    tracks = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "element_at(array('de', 'en-US', 'fr', 'en'), cast((conv_id + turn) % 4 + 1 as int)) AS lang", "CASE WHEN turn % 2 = 0 THEN 'asr' END AS kind")
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang").startswith("en"), 1).when(~F.col("kind").eqNullSafe(F.lit("asr")), 2).otherwise(3)
    from ..operators.state import latest_wins

    return latest_wins(tracks.withColumn("r", rank), ["conv_id"], [F.col("r"), F.col("turn")]).select("conv_id", "turn", "lang")


@query("fnv_slots", """WITH RECURSIVE s AS (SELECT doc_id, 'seed:' || doc_id AS x FROM labels), h(doc_id, x, i, v) AS (
    SELECT doc_id, x, 0, CAST(2166136261 AS BIGINT) FROM s UNION ALL SELECT doc_id, x, i + 1, (xor(v, CAST(ord(substr(x, i + 1, 1)) AS BIGINT)) * 16777619) & 4294967295 FROM h WHERE i < length(x))
    SELECT doc_id, v AS hash, CASE WHEN v % 2 = 0 THEN 'A' ELSE 'B' END AS slot0, CASE WHEN v % 2 = 1 THEN 'A' ELSE 'B' END AS slot1 FROM h WHERE i = length(x)""")
def fnv_slots(spark, sf):
    """Blind slots alternate with the repeat, from a seeded hash of the id."""
    h = table(spark, sf, "labels").select("doc_id", t.fnv1a(F.concat(F.lit("seed:"), "doc_id")).alias("hash"))
    slot = lambda r: F.when((F.col("hash") + r) % 2 == 0, F.lit("A")).otherwise(F.lit("B"))
    return h.select("doc_id", "hash", slot(0).alias("slot0"), slot(1).alias("slot1"))


@query("date_keys", sql("stories", """SELECT id, CASE WHEN length(time_iso) < 10 THEN '0000-00-00' ELSE substr(time_iso, 1, 10) END AS day,
    CASE WHEN length(time_iso) >= 10 THEN strftime(CAST(substr(time_iso, 1, 10) AS DATE), '%G-w%V') END AS week,
    CASE WHEN length(time_iso) >= 10 THEN strftime(CAST(substr(time_iso, 1, 10) AS DATE) + INTERVAL 40 DAY, '%Y-%m-%d') ELSE '0000-00-00' END AS later FROM stories"""))
def date_keys(spark, sf):
    iso = F.col("time_iso")
    return stories(spark, sf).select("id", d.date_key(iso).alias("day"), F.when(F.length(iso) >= 10, d.iso_week_key(F.when(F.length(iso) >= 10, iso))).alias("week"), d.add_days(d.date_key(iso), 40).alias("later"))


@query("day_window", "SELECT event_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 86400 AS stop FROM events")
def day_window(spark, sf):
    start, stop = d.day_window(F.col("ts"))
    return table(spark, sf, "events").select("event_id", start.alias("start"), stop.alias("stop"))


@query("deploy_schedule", """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
    q AS (SELECT day, day(last_day(day)) AS n, day(day) - 1 AS i FROM days), r AS (SELECT day, 500 // n + CASE WHEN i < 500 % n THEN 1 ELSE 0 END AS quota FROM q)
    SELECT strftime(day, '%Y-%m-%d') AS day, quota, array_to_string(list_transform(range(0, quota), lambda k: (k * 24) // quota), ',') AS hours FROM r""")
def deploy_schedule(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    quota = d.deploy_quota(F.col("date"), F.lit(500))
    return days.select(F.date_format("date", "yyyy-MM-dd").alias("day"), quota.alias("quota"), F.array_join(d.deploy_hours(quota).cast("array<string>"), ",").alias("hours"))


@query("slot_keys", "SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS slot, strftime(ts, '%Y-%m') AS month FROM events")
def slot_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", d.slot_key(F.col("ts")).alias("slot"), d.month_key(F.col("ts")).alias("month"))


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), 0) AS missing FROM events")
def json_fields(spark, sf):
    parsed = F.from_json("props", "k long, missing long")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(parsed["missing"], F.lit(0)).alias("missing"))


@query("error_details", """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'HTTP 429: {"retry_after": ' || event_id % 60 || '}' WHEN event_id % 3 = 1 THEN 'HTTP 500: oops' ELSE 'reset in 250ms' END AS m FROM events)
    SELECT event_id, CASE WHEN regexp_matches(m, 'HTTP 429') THEN 'rate_limit' ELSE 'call' END AS kind, TRY_CAST(regexp_extract(m, '"retry_after": *([0-9]+)', 1) AS BIGINT) AS retry_after,
    TRY_CAST(regexp_extract(m, '([0-9]+)ms', 1) AS BIGINT) AS reset_ms FROM e""")
def error_details(spark, sf):
    m = F.expr("""CASE WHEN event_id % 3 = 0 THEN concat('HTTP 429: {"retry_after": ', event_id % 60, '}') WHEN event_id % 3 = 1 THEN 'HTTP 500: oops' ELSE 'reset in 250ms' END""")
    number = lambda p: F.regexp_extract(m, p, 1).try_cast("long")
    return table(spark, sf, "events").select("event_id", F.when(m.contains("HTTP 429"), F.lit("rate_limit")).otherwise(F.lit("call")).alias("kind"), number('"retry_after": *([0-9]+)').alias("retry_after"), number("([0-9]+)ms").alias("reset_ms"))


@query("containment_score", f"""WITH a AS (SELECT item_id, text FROM benchmark), n AS (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}{CHARS}]+', ' ', 'g') AS x FROM a),
    s AS (SELECT item_id, list_distinct(list_transform(list_filter({duck_words('x')}, lambda w: length(w) >= 3 AND NOT list_contains([{", ".join(f"'{w}'" for w in q.STOP_WORDS)}], w)), lambda w: substr(w, 1, 6))) AS st FROM n)
    SELECT p.item_id AS a, r.item_id AS b, round(CASE WHEN least(len(p.st), len(r.st)) > 0 THEN len(list_intersect(p.st, r.st)) / CAST(least(len(p.st), len(r.st)) AS DOUBLE) ELSE 0 END, 6) AS score
    FROM s p JOIN s r ON r.item_id = p.item_id + 1""")
def containment_score(spark, sf):
    s = table(spark, sf, "benchmark").select("item_id", q.stems(F.col("text")).alias("st"))
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(q.containment(F.col("a.st"), F.col("b.st")), 6).alias("score"))
