"""Operators on small tables."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.operators import services as sv
from brindle.operators import state as st
from brindle.operators import stats, threads
from brindle.plans.catalog import QUERIES
from brindle.plans.tables import evaluation
from brindle.sources import readers, sinks
from brindle.sources.ranges import bisect, ranged_source
from brindle.streaming import microbatch as mb

COMMENT = "story_id long, id long, parent long, pos int, author string, text string"


def thread(spark, rows):
    return spark.createDataFrame([(100, i, p, k, "u", x) for k, (i, p, x) in enumerate(rows)], COMMENT)


def test_orphans_and_cycles(spark):
    linked = threads.parent_links(thread(spark, [(1, 100, "root"), (2, 77, "orphan"), (1, 100, "again"), (3, 2, " ")]))
    assert sorted((r.id, r.parent_id) for r in linked.collect()) == [(1, None), (2, None)]
    out = threads.render_threads(threads.parent_links(thread(spark, [(1, 2, "a"), (2, 1, "b")])), 500).first()
    assert out.included == [1, 2] and out.text.split("\n")[1].startswith("  > [comment_id=2")


def test_branch_order_and_budget(spark):
    rows = [(1, 100, "one"), (2, 100, "x" * 50), (3, 100, "two"), (4, 2, "r"), (5, 2, "s"), (6, 3, "t")]
    linked = threads.parent_links(thread(spark, rows))
    ranks = {r.root: (r.size, r["rank"]) for r in threads.branch_table(linked).where("id = root").collect()}
    assert ranks == {2: (3, 0), 3: (2, 1), 1: (1, 2)}
    out = threads.render_threads(linked, 60).first()
    assert out.included == [3, 6] or out.included == [3, 6, 1]
    assert 2 in out.dropped and out.dropped[0] == 2 or out.dropped[0] == 1
    assert threads.pack([900, 200, 50], 300) == [1, 2]


def test_crawl(spark):
    rows = [(1, 100, "a"), (2, 100, " "), (3, 2, "b"), (4, 3, "deep")]
    got = [(r.id, r.depth) for r in threads.crawl(thread(spark, rows), 2, 10).collect() if r.emitted]
    assert got == [(1, 1), (3, 2)]
    chain = [(1, 100, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d")]
    assert [r.id for r in threads.crawl(thread(spark, chain), 9, 3).collect()] == [1, 2, 3]
    seen = spark.createDataFrame([(100, 2, 2)], "story_id long, depth int, id long")
    assert [r.id for r in threads.crawl(thread(spark, chain), 9, 9, seen).collect()] == [1]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "h"), (2, "b", "g")], "id long, v string, h string")
    new = spark.createDataFrame([(2, None, None), (3, "c", None)], "id long, v string, h string")
    got = sorted(tuple(r) for r in st.upsert(old, new, ["id"], keep=("h",)).collect())
    assert got == [(1, "a", "h"), (2, None, "g"), (3, "c", None)]


def test_cascade(spark):
    stories = spark.createDataFrame([(i, 74 if i <= 101 else 75) for i in range(1, 106)], "id long, score long")
    kept = st.cascade({"stories": (stories, "id")}, st.doomed(stories, 75))["stories"]
    assert kept.count() == 4


def test_pending(spark):
    stories = spark.createDataFrame([(1001, 0), (1002, 1)], "id long, rank int")
    state = spark.createDataFrame([(1001, "error", "ok", "ok", "4", "2024-01-02T00:00:00.000Z")], "story_id long, post_status string, comments_status string, tags_status string, policy string, updated_at string")
    assert [r.id for r in st.pending(stories, state, "4", "2024-01-01T12:00:00.000Z", 10).collect()] == [1002]
    assert [r.id for r in st.pending(stories, state, "4", "2024-01-03T00:00:00.000Z", 10).collect()] == [1001, 1002]


def test_leaderboard(spark):
    rows = [("m/a", True, None, 100, 10, [], 4.0, 5.0, False), ("m/a", False, None, 200, 20, ["too_short"], None, None, None), ("m/b", False, "x", 50, 0, [], None, None, None)]
    runs = spark.createDataFrame(rows, "model string, ok boolean, error string, latency_ms long, output_chars long, reasons array<string>, overall double, purity double, refused boolean")
    runs = runs.withColumns({"accuracy": F.col("overall") - 1, "completeness": F.col("overall"), "faithfulness": F.lit(2.0), "format_adherence": F.lit(3.0)})
    got = {r.model: r for r in stats.leaderboard(runs).collect()}
    assert (got["m/a"].pass_rate, got["m/a"].mean_overall, got["m/a"].composite, got["m/a"].p50, got["m/a"].mean_purity) == (0.5, 4.0, 2.0, 100.0, 5.0)
    assert (got["m/a"].mean_accuracy, got["m/a"].mean_faithfulness, got["m/b"].mean_format_adherence) == (3.0, 2.0, None)
    assert got["m/b"].error_rate == 1.0
    assert ("m/b", "candidate_error", 1) in {tuple(r) for r in stats.failures(runs).collect()}


def test_bootstrap():
    assert stats.bootstrap_lower([0.5] * 20, 42) == 0.5
    assert stats.bootstrap_lower([], 1) is None

    def slow(seed, n):  # the generator, one number at a time
        state, out = seed & 0xFFFFFFFF, []
        for _ in range(n):
            state = (state + 1831565813) & 0xFFFFFFFF
            x = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
            x ^= (x + ((x ^ x >> 7) * (x | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            out.append((x ^ x >> 14) / 4294967296)
        return out

    assert np.allclose(stats.random_stream(7, 50), slow(7, 50))
    assert np.allclose(stats.random_stream(7, 30, 20), slow(7, 50)[20:])


def test_bootstrap_over_a_table(spark):
    """In one lot of values and in several, with a null id; and as the plain sums of a generator that comes round."""
    values = np.random.default_rng(5).normal(size=503)
    rows = spark.createDataFrame([(None if k == 0 else k * 7, float(v)) for k, v in enumerate(values)], "story_id long, delta double").repartition(3)
    want = stats.bootstrap_lower(list(values), 1, 300)
    for stories in (1000, 503, 120):
        n, lower = stats.bootstrap_bound(rows, 1, 300, stories)
        assert n == 503 and abs(lower - want) < 1e-12
    assert stats.bootstrap_bound(rows.limit(0), 1, 300) == (0, None)
    numbers = np.random.default_rng(6).random(64)
    for n, iterations in ((3, 7), (10, 30), (64, 5), (200, 9)):
        cuts = stats.segments(n, iterations, 64)
        sums = np.array([numbers[a:b].sum() for a, b in zip(cuts, cuts[1:])])
        slow = np.resize(numbers, n * iterations).reshape(iterations, n).sum(axis=1)
        assert np.allclose(stats.resampled(cuts, sums, n, iterations, 64), slow, atol=1e-9)


def test_bootstrap_bound_of_many_stories(spark, tmp_path):
    """More stories than 100,000 used to be an error."""
    spark.range(1, 130_001).toDF("doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["bootstrap_bound"](spark, str(tmp_path)).first()
    assert got.n == stats.story_deltas(evaluation(spark, str(tmp_path))).count() > 100_000
    assert got.lower == 0.5  # every story's difference


def test_release_gate_of_many_stories(spark, tmp_path):
    """All ten checks beyond 100,000 stories, nine of them as the gate without the bootstrap has them."""
    spark.range(1, 120_001).toDF("doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    got = [tuple(r) for r in QUERIES["release_gate_full"](spark, str(tmp_path)).collect()]
    assert got.pop(2) == ("bootstrap_95_lower", True)
    assert got == [tuple(r) for r in QUERIES["release_gate"](spark, str(tmp_path)).collect()]


def test_services(spark):
    prompts = spark.createDataFrame([(1, "a b c"), (2, "")], "id long, prompt string")
    model = sv.EchoModel({"busy": 429, "broken": 500}, frozenset({"obj"}))
    out = {r.id: r for r in sv.generate(prompts, model, ["busy", "broken", "obj"], structured=True).collect()}
    assert json.loads(out[1].text)["tags"][0]["name"] == "a" and out[1].model == "obj"
    assert [a.status for a in out[1].attempts] == ["rate_limit", "error", "error", "ok"]
    assert sv.CallError(400).permanent and not sv.CallError(503).permanent
    urls = spark.createDataFrame([(1, "u"), (2, "v"), (3, "w")], "id long, url string")
    pages = sv.fetch_pages(urls, sv.TableFetcher({"u": "<p>hi</p>", "v": "<title>Just a moment"}), sv.TableFetcher({"v": "x" * 50}))
    assert {r.id: (r.source, bool(r.markdown)) for r in pages.collect()} == {1: ("html", True), 2: ("reader", True), 3: ("missing", False)}


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "7.json").write_text('{"id": 7, "title": "a", "score": 3}\n{bad\n')
    (tmp_path / "in" / "sub" / "12.json").write_text('{"id": 12, "title": "b"}\n')
    rows = readers.json_lenient(spark, str(tmp_path / "in" / "7.json"), "id long, title string, score long").collect()
    assert [tuple(r) for r in rows] == [(7, "a", 3)]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.json_strict(spark, str(tmp_path / "in" / "7.json"), "id long").collect()
    assert sorted(r.id for r in readers.ids_in(spark, str(tmp_path / "in"), r"(\d+)\.json$").collect()) == [7, 12]
    keys = readers.objects(spark, str(tmp_path / "in")).select(readers.key_of(F.col("key"), str(tmp_path)).alias("k"))
    assert sorted(r.k for r in keys.collect()) == ["in/7.json", "in/sub/12.json"]
    (tmp_path / "m.json").write_text('{"articleIds": [3, 1]}')
    items = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, t string")
    assert [r.id for r in readers.manifest_items(spark, str(tmp_path / "m.json"), items).collect()] == [3, 1]


def test_ranged_source(spark):
    def fetch(start, stop, page):
        rows = [(t, t) for t in range(start - 1, stop + 1)]  # neighbours too
        return rows[page * 5 : page * 5 + 5], -(-len(rows) // 5)

    ranges = list(bisect(0, 16, lambda a, b: fetch(a, b, 0)[1], 2))
    assert [(r.start, r.stop) for r in ranges] == [(0, 8), (8, 16)] or all(r.stop - r.start <= 8 for r in ranges)
    spark.dataSource.register(ranged_source("ranged_test", "id long, time long", fetch, most=2))
    got = spark.read.format("ranged_test").option("start", 0).option("stop", 20).load()
    assert sorted(r.id for r in got.collect()) == list(range(20))


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert sinks.replace_if_changed(df, path) and not sinks.replace_if_changed(df.orderBy(F.desc("id")), path)
    assert sinks.replace_if_changed(df.where("id = 1"), path) and spark.read.parquet(path).count() == 1
    assert not sinks.append(df.limit(0), path) and sinks.append(df, path) and spark.read.parquet(path).count() == 3
    assert sinks.report(df).split("\n")[0] == "| id | v |"


def test_stream_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "story_id long, v string, at int").coalesce(1).write.parquet(src)
    each = mb.upsert_into(out, ["story_id"], "at")
    run = lambda check: mb.run_once(mb.new_files(spark, src, "story_id long, v string, at int"), str(tmp_path / check), each).awaitTermination()
    run("c1")
    first = sorted(map(tuple, spark.read.parquet(out).collect()))
    run("c2")  # all files again
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == first
    spark.createDataFrame([(2, "c", 2)], "story_id long, v string, at int").coalesce(1).write.mode("append").parquet(src)
    run("c1")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a", 1), (2, "c", 2)]


def test_notify_once(spark, tmp_path):
    sent, ledger = [], str(tmp_path / "ledger")
    each = mb.notify_into(ledger, lambda df: sent.extend(sorted(r.story_id for r in df.collect())))
    each(spark.createDataFrame([(1,), (2,), (2,)], "story_id long"), 0)
    each(spark.createDataFrame([(2,), (3,)], "story_id long"), 1)
    assert sent == [1, 2, 3]


def stream_of(spark, tmp_path, rows, schema, f, name):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    q = f(mb.new_files(spark, path, schema)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_seen_state(spark, tmp_path):
    rows = [(100, 1, 5), (100, 2, 6), (100, 2, 7)]
    got = stream_of(spark, tmp_path, rows, "story_id long, depth int, id long", mb.seen_filter, "seen")
    assert sorted(r.id for r in got.collect()) == [5, 6, 7]


def test_reservations(spark, tmp_path):
    rows = [("g", 1, 0, 60), ("g", 2, 10, 50), ("g", 3, 20, 40), ("g", 4, 70, 90), ("h", 5, 0, 500)]
    got = stream_of(spark, tmp_path, rows, "gateway string, id long, at long, tokens long", lambda s: mb.reservations(s, 100), "reserved")
    assert {r.id: r.admitted for r in got.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_merge_and_changes(spark):
    old = spark.createDataFrame([(1, 80), (2, 90)], "id long, score long")
    new = spark.createDataFrame([(2, 10), (3, 99)], "id long, score long")
    assert sorted(tuple(r) for r in st.merge_collections(old, new, "id", F.col("score") >= 75).collect()) == [(1, 80), (3, 99)]
    assert {r.id: r.change for r in st.changes(old, new, "id").collect()} == {1: "removed", 2: "changed", 3: "added"}


def test_forest_frame():
    rows = pd.DataFrame({"id": [3, 4], "pos": [0, 1], "text": ["a", "b"], "author": ["x", "y"], "parent_id": [None, 3]})
    assert threads.Forest(rows).branches() == [[(3, 0), (4, 1)]]


@pytest.mark.parametrize("cut_off", ["aside", "placed"])
def test_a_replace_that_was_cut_off_loses_nothing(spark, tmp_path, cut_off):
    path = f"{tmp_path}/table"
    sinks.replace(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, at long"), path)
    if cut_off == "aside":  # between the renames: the new table isn't in place
        os.rename(path, f"{path}.old")
        spark.createDataFrame([(9, "x", 9)], "id long, v string, at long").write.parquet(f"{path}.new")
    else:  # after both, before the old one is deleted
        spark.createDataFrame([(7, "old", 0)], "id long, v string, at long").write.parquet(f"{path}.old")
    mb.upsert_into(path, ["id"], "at")(spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id long, v string, at long"), 0)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    assert not os.path.exists(f"{path}.old") and not os.path.exists(f"{path}.new")


def test_put_overwrites_unless_asked_to_skip(spark, tmp_path):
    df, path = spark.range(3), f"{tmp_path}/object"
    assert sinks.put(df, path) and sinks.put(df, path)
    assert not sinks.put(df, path, skip_unchanged=True) and sinks.put(df.where("id > 0"), path, skip_unchanged=True)


def test_floor_rank(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 3, 3, None)] + [("b", 7)], "k string, v long")
    got = lambda p: {r.k: r.value for r in stats.floor_rank(rows, ["k"], "v", p).collect()}
    assert got(0.0) == {"a": 1, "b": 7} and got(0.5) == {"a": 3, "b": 7} and got(0.95) == {"a": 3, "b": 7} and got(1.0) == {"a": 5, "b": 7}
