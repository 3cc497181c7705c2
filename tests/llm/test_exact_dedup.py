from __future__ import annotations

import hashlib

from brindle.llm.exact_dedup import exact_dedup


def slow(rows):
    low = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for i, t in rows]
    out = []
    for i, t in low:
        ids = [j for j, u in low if u == t]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, rest binary, gid int")
    got = [tuple(r) for r in exact_dedup(spark, df, width=4, growth=2).collect()]
    assert sorted(got, key=str) == slow(rows)


def test_cases(spark):
    long = "Abc É " * 3000
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "É"), (6, "é"), (7, long), (8, long.replace("A", "a")), (9, long + "x"), (10, long + "y"), (11, "abcd"), (12, "abcdabcd"), (13, "ABCD"), (14, "abc")]
    check(spark, rows)


def test_repeated_rows_and_null_ids(spark):
    check(spark, [(1, "same"), (1, "same"), (1, "other"), (None, "same"), (None, "alone"), (2, "SAME")])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(spark, df).collect() == []
