"""Assembly of the published collection: stories with their summaries, tags and counts, filtered and ordered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import ARTIFACT
from ..functions.quality import drops, triggers
from ..functions.text import host, single_line, trimmed
from .gates import AGGREGATE_FLOOR, passes_gate, zero


def pivot_summaries(summaries: DataFrame, langs: tuple[str, ...] = ("en",)) -> DataFrame:
    """(story_id, post, comments): one row per story; a partial maximum per kind, no pivot job."""
    kept = summaries.where(F.col("lang").isin(*langs))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("summary"))).alias(kind)
    return kept.groupBy("story_id").agg(of("post"), of("comments"))


def tag_lists(tags: DataFrame) -> DataFrame:
    """(story_id, tags): distinct tags in order of position; a story has a handful."""
    return tags.groupBy("story_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"])).alias("tags"))


def fallback_text(comments: DataFrame, most: int = 280) -> DataFrame:
    """(story_id, fallback): the start of all comments' text in order. Only as much of each comment goes on as can be seen."""
    cut = comments.select("story_id", "pos", F.substring(single_line(F.col("text")), 1, most).alias("text"))
    joined = cut.groupBy("story_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("all"))
    return joined.select("story_id", F.substring(single_line(F.col("all")), 1, most).alias("fallback"))


def comments_text(compressed: Column, state: Column, persisted: Column, has_persisted: Column, fallback: Column) -> Column:
    """What a card shows of the comments: the compressed paragraph if usable, the persisted text even if empty, else the raw start."""
    return F.when(state == "usable", compressed).when(has_persisted, persisted).otherwise(fallback)


def cleaned(summary: Column, artifact: str = ARTIFACT) -> Column:
    """A summary without artifact and outer blanks. The relational store's artifact is the replacement character."""
    return trimmed(F.replace(F.coalesce(summary, F.lit("")), F.lit(artifact)))


def stays(clean: Column, guard_ok: Column | None = None) -> Column:
    """Whether a cleaned summary may be shown: something is left, its guard (if there is one) let it pass, and no trigger says to drop it."""
    refused = F.lit(False) if guard_ok is None else guard_ok.eqNullSafe(F.lit(False))
    return (clean != "") & ~refused & ~drops(triggers(clean))


def published(stories: DataFrame, summaries: DataFrame, tags: DataFrame, least_score: int = 300, least_comments: int = 100, floor: int = AGGREGATE_FLOOR) -> DataFrame:
    """The collection: stories above the floor and the gate with a summary that stays, with domain, tags and comments' text.

    Stories are filtered before they meet their children, and children are reduced to one row per
    story before the joins, all on the story id.
    """
    kept = stories.where((zero(F.col("score")) >= floor) & passes_gate(F.col("score"), F.col("descendants"), least_score, least_comments))
    post = summaries.where("kind = 'post'").where(stays(cleaned(F.col("summary")), F.col("guard_ok"))).select("story_id", cleaned(F.col("summary")).alias("post"))
    comments = summaries.where("kind = 'comments'").select("story_id", F.col("summary").alias("comments_text"))
    rows = kept.join(post.withColumnRenamed("story_id", "id"), "id")
    rows = rows.join(comments.withColumnRenamed("story_id", "id"), "id", "left").join(tag_lists(tags).withColumnRenamed("story_id", "id"), "id", "left")
    return rows.withColumn("domain", host(F.col("url"))).withColumn("comments_count", F.col("descendants"))


def newest_first(ts: Column, row_id: Column) -> list[Column]:
    """Valid times first, newest first; ties and invalid times by id, highest first."""
    return [ts.desc_nulls_last(), row_id.desc()]


def placed(items: DataFrame, bucket: Column, bucket_order: Callable[[Column], Column], order: list[Column]) -> DataFrame:
    """Adds place (from 1) in the whole order and total, without sorting all rows in one task.

    order sorts by bucket first; rows are numbered within buckets (a day, say), and buckets' sizes, one row each, are summed up.
    """
    rows = items.withColumn("_b", bucket)
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    sizes = numbered.groupBy("_b").agg(F.max("_n").alias("_size"))
    before = F.sum("_size").over(Window.orderBy(bucket_order(F.col("_b"))).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_b").alias("_o"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("total"))
    both = numbered.join(offsets, F.col("_b").eqNullSafe(F.col("_o")))
    return both.withColumn("place", (F.col("_before") + F.col("_n")).cast("int")).drop("_b", "_o", "_n", "_before")


def search_index(items: DataFrame) -> DataFrame:
    """What the search page loads of each item; the domain only where there is one."""
    return items.select("id", "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "time_iso", zero(F.col("score")).alias("score"), "domain")


def grouped_ids(items: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """(key, pos, id): ids of each day or week in collection order, as rows; a key's list is made only on export."""
    keyed = items.withColumn("key", key)
    return keyed.select("key", (F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).alias("pos"), "id")
