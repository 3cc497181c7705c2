"""The corpus operators as registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, remainder, spread
from .exact_dedup import exact_dedup
from .language_id import language_id
from .language_model import lm_scores
from .media import media_columns
from .mixing import mix_sources
from .packing import pack
from .quality import quality_scores
from .repeats import remove_repeats
from .secrets import find_secrets
from .simhash import simhash_components


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, spread(documents(spark, sf_dir)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spread(documents(spark, sf_dir)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    learn = docs.where(remainder(4) != 2)
    out = language_id(spark, docs.withColumn("held_out", remainder(4) == 2), learn, keep=("held_out",))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix_sources(spark, documents(spark, sf_dir)).taken()
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spread(documents(spark, sf_dir))).drop("found")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark, spread(documents(spark, sf_dir)))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir).select("doc_id", "text")).withColumn("held_out", remainder(10) == 0)
    return lm_scores(spark, docs.withColumn("learn", ~F.col("held_out")), keep=("held_out",))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spread(documents(spark, sf_dir)))


def learnable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality) of the labels that aren't held out."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(3) != 1).select("doc_id", "quality")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir).select("doc_id", "text"))
    out = quality_scores(spark, docs.withColumn("held_out", remainder(3) == 1), learnable_labels(spark, sf_dir), keep=("held_out",))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_media": op8_media,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
}

#: DuckDB twins, where SQL can express an operator's result.
ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": """
        WITH d AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
}
