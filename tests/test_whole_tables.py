"""Queries without a twin take whole tables."""

from __future__ import annotations

from collections import Counter

from brindle.plans import catalog


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_quota_select_finds_all_sizes(spark, tmp_path):
    rows = [(i, "x", ("en", "fr", "de")[i % 3], "a", 15000 if i < 120 else 8000 if i < 150 else 100) for i in range(180)]
    got = catalog.QUERIES["quota_select"](spark, documents(spark, tmp_path, rows)).collect()
    count, left, want = Counter(r.bucket for r in got), list(rows), {"long": 5, "medium": 5, "short": 4, "en": 5, "fr": 3}
    names = lambda r: ("long" if r[4] == 15000 else "medium" if r[4] == 8000 else "short", r[2])
    assert count["long"] >= 5 and count["medium"] >= 5 and count["short"] >= 4
    for r in sorted(got, key=lambda r: r.place):  # the greedy rule over all rows
        best = max(left, key=lambda x: (sum(want.get(k, 0) > 0 for k in names(x)), -x[0]))
        assert r.doc_id == best[0]
        left.remove(best)
        for k in names(best):
            want[k] = want.get(k, 0) - 1


def test_texts_are_taken_whole(spark, tmp_path):
    long = "слово " * 100
    sf = documents(spark, tmp_path, [(1, long, "ru", "a", 600), (2, long + "this is plain english text at the end", "ru", "a", 637)])
    runs = {r.doc_id: r.runs for r in catalog.QUERIES["latin_runs"](spark, sf).collect()}
    assert runs[2] > runs[1]
    assert {r.doc_id: r.chars for r in catalog.QUERIES["unicode_forms"](spark, sf).collect()} == {1: 604, 2: 641}
