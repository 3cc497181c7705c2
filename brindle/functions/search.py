"""Ranking of search results: scores of titles, domains and tags."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_score(text: Column, query: str) -> Column:
    """0.95 to 1 by position where the text contains the query in any case; null where it doesn't. An empty query scores 1."""
    if not query:
        return F.lit(1.0)
    low = F.lower(text)
    at = F.locate(query.lower(), low) - 1
    return F.when(at >= 0, 0.95 + F.greatest(F.lit(0.0), 1 - at / F.length(low) * 0.5) * 0.05)


def subsequence_score(text: str | None, query: str) -> float:
    """0.3 to 0.7 if all signs of the query come in order, densely enough; else 0."""
    if not text or len(query) <= 2:
        return 0.0
    text, query = text.lower(), query.lower()
    at, gaps = 0, 0
    for sign in text:
        if at < len(query) and sign == query[at]:
            at += 1
        elif 0 < at < len(query):
            gaps += 1
    share = len(query) / len(text)
    if at < len(query) or share < (0.15 if len(text) < 20 else 0.1):
        return 0.0
    return max(0.3, min(0.7, share * 3 + share * 0.5) * max(0.0, 1 - gaps / len(text) * 2))


def fuzzy_score(text: Column, query: str) -> Column:
    """The exact score, else that of a subsequence, which only rows without an exact hit compute; 0 for no match."""
    exact = exact_score(text, query)

    @F.pandas_udf("double")
    def loose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: subsequence_score(t, query)).astype(float)

    return F.coalesce(exact, loose(F.when(exact.isNull(), text)))


def subsequence(text: Column, query: str) -> Column:
    """subsequence_score() of short texts as a Column."""
    if len(query) <= 2:
        return F.lit(0.0)
    signs, low, n = F.split(F.lower(text), ""), query.lower(), len(query)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gaps"))

    def step(acc: Column, sign: Column) -> Column:
        wanted = F.substring(F.lit(low), acc["at"] + 1, F.lit(1))
        hit = (acc["at"] < n) & (sign == wanted)
        gap = ~hit & (acc["at"] > 0) & (acc["at"] < n)
        return F.struct((acc["at"] + hit.cast("int")).alias("at"), (acc["gaps"] + gap.cast("int")).alias("gaps"))

    size = F.length(text)
    share = F.lit(float(n)) / size
    dense = share >= F.when(size < 20, 0.15).otherwise(0.1)
    score = lambda acc: F.when((acc["at"] == n) & dense, F.greatest(F.lit(0.3), F.least(F.lit(0.7), share * 3 + share * 0.5) * F.greatest(F.lit(0.0), 1 - acc["gaps"] / size * 2))).otherwise(0.0)
    return F.when(size > 0, F.aggregate(F.filter(signs, lambda s: s != ""), zero, step, score)).otherwise(0.0)


def tag_score(tags: Column, queries: list[str]) -> Column:
    """Mean of the best scores of all query terms, null where they don't match. Tags are compared in lower case, terms as they are.

    Equal 1, prefix or suffix 0.9, part 0.8 (terms of 3 on), tag within the term 0.7 (tags of 3 on), and half the score of a
    dense subsequence (over 0.6; terms and tags of 4 on).
    """
    if not queries:
        return F.lit(1.0)
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)

    half = lambda s: F.when(s > 0.6, s * 0.5).otherwise(0.0)

    def best(q: str) -> Column:
        one = lambda t: (
            F.when(t == q, 1.0)
            .when(t.startswith(q) | t.endswith(q), 0.9)
            .when(t.contains(q) & F.lit(len(q) >= 3), 0.8)
            .when(F.lit(q).contains(t) & (F.length(t) >= 3), 0.7)
            .when(F.lit(len(q) >= 4) & (F.length(t) >= 4), half(subsequence(t, q)))
            .otherwise(0.0)
        )
        return F.coalesce(F.array_max(F.transform(low, one)), F.lit(0.0))

    scores = F.array(*(best(q) for q in queries))
    n = len(queries)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    hits = F.size(F.filter(scores, lambda x: x > 0))
    exact = F.size(F.filter(scores, lambda x: x == 1))
    fits = (total >= 0.7) if n == 1 else (hits / n >= 0.7) & ((exact / n >= 0.3) | (total / n >= 0.8))
    return F.when(fits, total / n)


def relevance(title: Column | None, domain: Column | None, tags: Column | None, score: Column) -> Column:
    """Weighted mean of the given scores (title 4, domain 1, tags 3), and up to 0.15 for votes."""
    parts = [(c, w) for c, w in ((title, 4.0), (domain, 1.0), (tags, 3.0)) if c is not None]
    mean = sum((c * w for c, w in parts), F.lit(0.0)) / sum(w for _, w in parts) if parts else F.lit(1.0)
    return mean + F.least(F.lit(0.15), F.coalesce(score, F.lit(0)) / 800)


def result_order(exact: Column, rel: Column, score: Column, ts: Column, row_id: Column) -> list[Column]:
    """Exact first, then relevance in steps of 0.02, votes in steps of 50, newest, id: a total order, unlike comparing with tolerances."""
    return [exact.desc(), F.round(rel / 0.02).desc(), F.floor(F.coalesce(score, F.lit(0)) / 50).desc(), ts.desc_nulls_last(), row_id.desc()]
