"""Literal cases of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.functions import dates as d
from brindle.functions import markup as mk
from brindle.functions import quality as q
from brindle.functions import search as se
from brindle.functions import tags as tg
from brindle.functions import text as t
from brindle.functions.language_gate import analyze
from brindle.operators import gates as g


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("day", "week"), [("2020-12-31", "2020-w53"), ("2021-01-01", "2020-w53"), ("2021-01-04", "2021-w01")])
def test_iso_week(spark, day, week):
    assert one(spark, d.iso_week_key(F.lit(day + "T10:00:00Z"))) == week


def test_date_keys(spark):
    assert one(spark, d.date_key(F.lit("2024-02-29T23:00:00Z"))) == "2024-02-29"
    assert one(spark, d.date_key(F.lit("short"))) == "0000-00-00"
    assert one(spark, d.add_days(F.lit("2024-02-29"), 1)) == "2024-03-01"
    assert one(spark, d.add_days(F.lit("2023-02-28"), 1)) == "2023-03-01"
    assert one(spark, d.add_days(F.lit("bad"), 1)) == "bad"


@pytest.mark.parametrize(("day", "quota"), [(1, 18), (24, 18), (28, 17)])
def test_deploy_quota(spark, day, quota):
    assert one(spark, d.deploy_quota(F.lit(f"2026-02-{day:02d}").cast("date"), F.lit(500))) == quota


@pytest.mark.parametrize(("name", "slug"), [("C++/CLI & .NET", "c++-cli-.net"), ("  Web Assembly  ", "web-assembly"), ("don’t-test—me", "dont-test-me"), ("", "")])
def test_slugify(spark, name, slug):
    assert one(spark, t.slugify(F.lit(name))) == slug


@pytest.mark.parametrize(("name", "slug"), [("JS", "javascript"), ("react", "reactjs"), ("psql", "postgresql")])
def test_canonical(spark, name, slug):
    assert one(spark, tg.canonical(F.lit(name))) == slug


def test_combined_tags(spark):
    given = F.array(F.lit("react"), F.lit("Open AI"), F.lit("postgres"))
    got = one(spark, tg.combined_tags(given, F.lit("React and Postgres at work"), F.lit("github.com")))
    assert got == ["reactjs", "openai", "postgresql", "github"]


@pytest.mark.parametrize(("title", "has"), [("Rust c++ news", False), ("c++x", True), ("cpp now", True), ("C# dev", False)])
def test_signs_at_word_ends(spark, title, has):
    assert ("cpp" in one(spark, tg.title_tags(F.lit(title)))) == has


def test_containment(spark):
    score = lambda a, b: one(spark, q.containment(q.stems(F.lit(a)), q.stems(F.lit(b))))
    assert score("Feature flags, rollouts!", "feature FLAGS rollouts") == 1.0
    assert score("Feature flags need cleanup after rollout", "Teams forget cleanup of feature flags after a rollout") >= 0.7
    assert score("Compilers are slow", "Bees make honey") < 0.7
    assert score("", "x") == 0.0


def test_survivors(spark):
    sets = lambda *xs: F.array(*(q.stems(F.lit(x)) for x in xs))
    head = q.stems(F.lit("Alpha beta gamma"))
    assert one(spark, q.survivors(head, sets("alpha beta gamma", "delta epsilon zeta"))) == [1]
    assert one(spark, q.survivors(head, sets("one1 two2 three3", "one1 two2 three3!", "four4 five5 six6"))) == [0, 2]


@pytest.mark.parametrize(
    ("score", "comments", "least", "passes"),
    [(299, 9999, (300, 0), False), (300, 0, (300, 0), True), (50, 150, (300, 100), True), (299, 99, (300, 100), False), (None, None, (300, 100), False), (None, None, (0, 0), True)],
)
def test_gate(spark, score, comments, least, passes):
    assert one(spark, g.passes_gate(F.lit(score).cast("int"), F.lit(comments).cast("int"), *least)) == passes


def test_triggers(spark):
    found = lambda s, **k: one(spark, q.triggers(F.lit(s), **k))
    assert found(None) == ["empty"] and found("  ") == ["empty"]
    assert found("- a\n- b") == ["too_short", "too_few_words", "bullets_only"]
    assert found("- a\n- b", kind="comments") == ["too_short", "too_few_words"]
    assert "refusal" in found("I'm sorry, but we are unable to do so")
    assert "repetition_run" in found("go " * 30)
    good = " ".join(f"word{i} follows another" for i in range(20))
    assert found(good) == []


def test_rejection_score(spark):
    assert one(spark, q.rejection_score(F.array(F.lit("refusal"), F.lit("too_short"), F.lit("unknown")))) == 975


CASES = [
    ("Автор разбирает последствия закона и объясняет, почему такие меры создают precedents для слежки за пользователями.", {"latin"}),
    ("Игрок выбирает стратегию, а система очков lets you compare results globally между всеми участниками.", {"low", "latin"}),
    ("THIS ARTICLE EXPLAINS WHY DISTRIBUTED SYSTEMS NEED CAREFUL RECOVERY PLANS AND REGULAR FAILURE TESTING.", {"low"}),
    ("Автор пишет: «lets you compare results globally», после чего продолжает подробный разбор на русском языке.", {"low", "latin"}),
    ("Компания OpenAI admits ошибку и обещает исправить поведение новой версии после дополнительного тестирования.", {"latin"}),
    ("При ошибке появляется сообщение «Something went wrong», после чего интерфейс предлагает повторить операцию.", set()),
    ("Исследование Institute for Highway Safety сравнивает результаты испытаний и объясняет различия методик.", set()),
    ("Производитель осевого (axial flux) двигателя подробно описывает новую конструкцию и результаты испытаний.", set()),
    ("- Пользователи обсуждают команду brew bundle и делятся способами ускорить установку пакетов", set()),
]


@pytest.mark.parametrize(("text", "signals"), CASES)
def test_language_gate(text, signals):
    r = analyze(text)
    assert ({"low"} if r["low_ratio"] else set()) | ({"latin"} if r["runs"] or r["singles"] else set()) == signals


def test_extract_metrics(spark):
    text = "# Title\n" + " ".join(["word"] * 12) + "\n[a](b) [c](d)\n" + "短い文章" * 10
    m = one(spark, q.extract_metrics(F.lit(text)))
    assert m.prose_chars == 59 + 40 + 2 * 40
    assert m.word_count == 2 + 12 + 2 + 21
    assert round(m.link_density, 6) == round(2 / 37, 6)


def test_urls(spark):
    assert one(spark, t.host(F.lit("HTTPS://user@www.GitHub.com:80/a b"))) == "github.com"
    assert one(spark, t.host(F.lit("ftp://x.org"))) is None
    for url, want in (("https://youtu.be/abc?t=1", "abc"), ("https://www.youtube.com/watch?a=1&v=xy#z", "xy"), ("https://m.youtube.com/shorts/q1/", "q1"), ("https://x.org/watch?v=1", None)):
        assert one(spark, t.video_id(F.lit(url))) == want
    assert one(spark, t.safe_http_url(F.lit("https://u:p@x.org"))) is None


def test_clamps(spark):
    assert one(spark, t.clamp_clause(F.lit("Short one. Then a longer sentence ends here. And a cut wo"))) == "Short one. Then a longer sentence ends here."
    assert one(spark, t.clamp_clause(F.lit("a run-on sentence that has no end at a"))) == "a run-on sentence that has no end at…"
    assert one(spark, t.clamp_display(F.lit("twenty characters and more of them"), 30)) == "twenty characters and more of…"
    assert one(spark, t.teaser(F.lit("## Head\ntext\n- **Bold** [link](http://x)\n- next"))) == "Bold link"
    assert one(spark, t.clean_model_output(F.lit('```text\n"Итог: one two."\n```'))) == "one two."
    assert one(spark, t.fnv1a(F.lit("a"))) == 0xE40C292C


def test_markup():
    assert mk.html_plain("<p>Hello world again</p><p>x<br/>y</p><ul><li>one two</li></ul>") == "Hello world again\n\nx\ny\n\n\n• one two".replace("\n\n\n", "\n\n")
    assert mk.chunks("ab" * 30, 20) == ["ab" * 10] * 3
    long = "x" * 15 + "\n\n" + "y" * 10
    assert mk.chunks(long, 20) == ["x" * 15 + "\n\n", "y" * 10]
    assert "".join(mk.chunks(long * 9, 20)) == long * 9
    assert mk.first_object('a {"b": "}{", "c": {"d": "\\""}} e') == '{"b": "}{", "c": {"d": "\\""}}'
    assert mk.first_object("{ never") is None
    assert mk.markdown_html("# A\n\n- *b*\n- `c`\n\n<script>") == "<h1>A</h1>\n<ul><li><em>b</em></li><li><code>c</code></li></ul>\n<p>&lt;script&gt;</p>"
    page = "<html><title>T</title><nav>menu</nav><article><h1>Head</h1><p>" + "word " * 60 + "</p></article></html>"
    assert mk.page_markdown(page).startswith("# T\n\n# Head\n\nword word") and "menu" not in mk.page_markdown(page)
    assert len(mk.message("t", "http://x", "s&" * 500, "tease", 300)) <= 300


def test_search(spark):
    assert one(spark, se.exact_score(F.lit("A Python web"), "python")) == pytest.approx(0.95 + 0.05 * (1 - 2 / 12 * 0.5))
    assert se.subsequence_score("python web", "pthn web") > 0.3 and se.subsequence_score("abc", "ab") == 0
    tags = F.array(F.lit("Rust"), F.lit("databases"))
    assert one(spark, se.tag_score(tags, ["rust", "data"])) == pytest.approx(0.95)
    assert one(spark, se.tag_score(tags, ["zzz"])) is None


def test_cards(spark):
    from brindle.functions import render as rd

    insight = lambda k, x: F.struct(F.lit(k).alias("kind"), F.lit(x).alias("text"))
    insights = F.array(insight("dispute", "Costs are too high."), insight("advice", "Use_less."), insight("consensus", "Costs are too high!"), insight("consensus", "Third point here."), insight("consensus", "Fourth thing there."))
    quoted = rd.quote(F.lit("line one\n\nline *two*"), F.lit("@@ann"), F.lit(" "))
    p = one(spark, rd.parts(F.lit("A bottom line."), insights, quoted))
    assert p.lead == "A bottom line.\n"
    assert p.visible == "- **Debate:** Costs are too high.\n- **Advice:** Use\\_less.\n- Third point here.\n"
    assert p.folded == "- Fourth thing there.\n\n> line one\n>\n> line \\*two\\*\n> — @ann\n" and p.folded_insights == 1
    label = rd.fold_label(F.struct(F.lit(1).alias("folded_insights"), F.lit(True).alias("folded_quote")), "ru")
    assert one(spark, label) == "ещё 1 тезис (+ цитата)"
    comments = F.array(*(F.struct(F.lit(a).alias("author"), F.lit(x).alias("text")) for a, x in (("u", "short"), ("v", "long " * 20), ("w", "more " * 20), ("x", "last " * 20))))
    card = one(spark, rd.fallback_card(comments))
    assert card.startswith("### From the discussion\n\n- **@v:** long") and card.count("\n- ") + card.count("\n\n- ") >= 2 and "last" not in card


def test_routes(spark):
    r = lambda i, n, **k: one(spark, g.route(F.lit(i), F.lit(n), 1000, 50, **k))
    assert tuple(r(10, 1000)) == ("short", "small", "under-short-cap")
    assert tuple(r(10, 6000)) == ("medium", "medium", "under-medium-cap")
    assert tuple(r(10, 7001)) == ("skip", "", "over-medium-cap")
    assert tuple(r(60, 1000)) == ("legacy", "small", "share-miss")
    assert r(10, 1000, enabled=False).reason == "routes-off" and r(10, 6000, medium="").reason == "medium-empty"


def test_guard(spark):
    v = lambda *a: one(spark, g.guard_verdict(*map(F.lit, a[:5]), F.array(*map(F.lit, a[5]))))
    assert tuple(v(True, True, False, 0.9, "ok", ["x"])) == (True, "ok", ["x"])
    assert tuple(v(True, False, True, 0.9, "ok", ["x"])) == (False, "not_article", ["not_article", "refusal"])
    assert tuple(v(True, True, False, 0.8, "other", [" a ", "a", "b", "c"])) == (False, "other", ["a", "b"])
    assert v(True, True, False, 0.65, "other", ["a"]).ok


def test_subsequence_column(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcab ") for _ in range(rng.randrange(30))) for _ in range(300)] + ["databases", "data bases", None]
    for query in ("abc", "ab", "cabab", "databses", "Databases"):
        rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", se.subsequence(F.col("x"), query).alias("s")).collect()
        assert all(r.s == pytest.approx(se.subsequence_score(r.x, query)) for r in rows)


def test_purity_reaches_the_triggers(spark, tmp_path):
    from brindle.plans import catalog

    spark.createDataFrame([(1, "x", "ru"), (2, "this is plain english text that goes on and on", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.reasons.split(",") for r in catalog.QUERIES["language_triggers"](spark, str(tmp_path)).collect()}
    assert {"low_cyrillic_ratio", "latin_prose"} <= set(got[2]) and not {"low_cyrillic_ratio", "latin_prose"} & set(got[1])


def test_search_page_puts_exact_first_and_stops(spark, monkeypatch):
    from brindle.plans import workflows as wf

    rows = [(k, "a Python web tool" if k % 2 else "pythonic webs", "example.org", ["x"], 10 * k, None) for k in range(12)]
    items = spark.createDataFrame(rows, "id long, title string, domain string, tags array<string>, score long, ts timestamp")
    shown = wf.search_page(items, "python web", "", []).orderBy("place").collect()
    assert [r.id for r in shown][:6] == [11, 9, 7, 5, 3, 1] and all(r.exact == (r.id % 2 == 1) for r in shown)
    monkeypatch.setattr(wf, "SCAN", 4)
    assert sorted(r.id for r in wf.search_page(items, "python web", "", []).collect()) == [8, 9, 10, 11]
    monkeypatch.setattr(wf, "SHOWN", 2)
    assert [r.id for r in wf.search_page(items, "python web", "", []).orderBy("place").collect()] == [11, 9]
