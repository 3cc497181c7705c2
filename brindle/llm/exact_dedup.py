"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes, most significant first: a round takes the next digit
(`width` bytes) of what is left of each text and splits every group by it. A group of one row is
done; so is a group whose digit is shorter than `width`, since all its texts have ended and are
equal. Only the rest goes on, without the digit. Equality is that of the bytes themselves.
Digits widen by `growth`, so a text of n bytes takes O(log n) rounds.

Scale: a round counts groups with map-side partial aggregation, so a group of any size arrives
in its task as one row per map task; rows learn their group by a join that adaptive execution
splits when a key is hot. Text moves once in the first round, and afterwards only for rows that
still share all earlier digits with another row. Each round ends in a written table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 128, growth: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts
    equal one another. The row with the largest id stays; a null id is below all others. Rows that
    repeat both id and text count each in group_size, and each that bears keep_id is marked kept.
    Columns other than id and text are ignored, whatever their names. No rows give no rows.
    """
    scratch = Scratch(spark, "exact-dedup")
    norm = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).cast("binary")
    active = docs.select(F.col(id_col).alias("id"), norm.alias("rest")).select("id", F.unhex(F.sha2("rest", 256)).alias("sha"), F.lit(0).cast("long").alias("gid"), "rest")
    done, level = [], 0
    while True:
        split = active.withColumn("digit", F.substring("rest", 1, width))
        groups = split.groupBy("gid", "digit").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where("n > 1")
        groups = scratch.save(groups.withColumn("next", F.monotonically_increasing_id()), f"groups{level}")
        goes_on = F.col("n").isNotNull() & (F.length("digit") == width)
        moved = split.join(groups.hint("merge"), ["gid", "digit"], "left").select(
            "id",
            "sha",
            F.col("next").alias("gid"),
            F.when(goes_on, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        )
        moved = scratch.save(moved, f"round{level}")
        done.append(moved.where("rest is null").drop("rest", "gid"))
        active = moved.where("rest is not null").select("id", "sha", "gid", "rest")
        if active.isEmpty():
            break
        width, level = width * growth, level + 1
    return reduce(DataFrame.unionAll, done).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
