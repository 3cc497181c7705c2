"""Typed sources. Schemas are explicit; bad rows are marked or dropped, never inferred around."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_ITEM = "id long, type string, title string, url string, text string, `by` string, time long, kids array<long>, parent long, score long, descendants long"
STORY = "id long, title string, url string, `by` string, timeISO string, commentIds array<long>, score long, descendants long"
COMMENT = "id long, `by` string, timeISO string, textPlain string, parent long, depth int"
POST_SUMMARY = "id long, lang string, summary string, degraded string, inputHash string, model string, createdISO string, guard struct<ok boolean, verdict string, reasons array<string>, confidence double>"
TAGS = "id long, lang string, tags array<struct<name string, cat string>>, inputHash string, model string, createdISO string"
INDEX = "updatedISO string, storyIds array<long>"
USAGE = "createdAt string, storyId long, label string, gateway string, modelRequested string, modelUsed string, attempt int, promptTokens long, completionTokens long, totalTokens long, status string"


def json_lenient(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """JSON documents under a schema; rows that don't parse are dropped."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multiline).json(path)
    return rows.where("_corrupt IS NULL").drop("_corrupt")


def json_strict(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """JSON documents under a schema; a row that doesn't parse fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multiline).json(path)


def parsed_or(text, schema: str, fallback):
    """A JSON column as a struct, or the fallback where it doesn't parse or is missing."""
    return F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE"}), fallback)


def objects(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(key, size, modified, body) of all files below a root: an object store as a table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("body"))


def key_of(path, root: str):
    """An object's key: its path below the root, without a leading data/."""
    return F.regexp_replace(F.regexp_replace(path, f"^(?:file:)?/*{root.strip('/')}/", ""), "^data/", "")


def ids_in(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Distinct ids read off file names by a regex's first group; files are listed, not read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", pattern, 1).alias("id"))
    return names.where("id <> ''").select(F.col("id").cast("long")).distinct()


def manifest_items(spark: SparkSession, manifest: str, items: DataFrame, ids: str = "articleIds") -> DataFrame:
    """Items that a manifest names, in its order."""
    wanted = spark.read.schema(f"{ids} array<long>").option("multiLine", True).json(manifest).select(F.posexplode(ids).alias("pos", "id"))
    return wanted.join(items, "id").orderBy("pos")
