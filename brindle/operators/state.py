"""Keyed state: upserts, cascades, pending work, change detection. Tables are DataFrames; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import zero


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones with the same keys. Columns in keep fall back to the old value where the new one is null.

    One shuffle by key; keys are unique on each side.
    """
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    fresh = F.col(f"b.{keys[0]}").isNotNull()
    out = []
    for c in old.columns:
        if c in keys or c in keep:
            out.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
        else:
            out.append(F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return a.join(b, on, "full").select(*out)


def latest_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with the same keys, the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of the parents that new mentions go; new ones, distinct, come."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.distinct())


def doomed(stories: DataFrame, floor: int) -> DataFrame:
    return stories.where(zero(F.col("score")) < floor).select("id")


def cascade(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of doomed ids. tables: name -> (rows, id column)."""
    return {name: rows.join(ids.select(F.col("id").alias(key)), key, "left_anti") for name, (rows, key) in tables.items()}


def pending(stories: DataFrame, state: DataFrame, policy: str, cutoff: str, limit: int) -> DataFrame:
    """Stories with work to do: without state, or with a part not ok or another policy and not touched since the cutoff."""
    s, p = stories.alias("s"), state.alias("p")
    open_ = F.lit(False)
    for part in ("post_status", "comments_status", "tags_status"):
        open_ = open_ | F.col(f"p.{part}").isNull() | (F.col(f"p.{part}") != "ok")
    open_ = open_ | F.col("p.policy").isNull() | (F.col("p.policy") != policy)
    due = F.col("p.updated_at").isNull() | (F.col("p.updated_at") < cutoff)
    rows = s.join(p, F.col("s.id") == F.col("p.story_id"), "left").where(F.col("p.story_id").isNull() | (open_ & due))
    return rows.orderBy(F.col("s.rank").asc_nulls_first(), F.col("s.id").desc()).select("s.id", "s.rank").limit(max(1, min(limit, 200)))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed between two collections; rows that stay the same are left out."""
    digest = lambda df: df.select(key, F.xxhash64(F.to_json(F.struct(*sorted(c for c in df.columns if c != key)))).alias("h"))
    a, b = digest(old).alias("a"), digest(new).alias("b")
    kind = F.when(F.col("a.h").isNull(), F.lit("added")).when(F.col("b.h").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").where(~F.col("a.h").eqNullSafe(F.col("b.h")))
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), kind.alias("change"))


def merge_collections(previous: DataFrame, latest: DataFrame, key: str, still: Column) -> DataFrame:
    """Both collections, latest rows first where both have one, and only rows that still qualify."""
    both = previous.withColumn("_age", F.lit(1)).unionByName(latest.withColumn("_age", F.lit(0)))
    return latest_wins(both, [key], [F.col("_age")]).drop("_age").where(still)


def input_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
