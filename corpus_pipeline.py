"""The corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, documents
from brindle.llm.exact_dedup import exact_dedup
from brindle.llm.mixing import mix_sources
from brindle.llm.near_dedup import near_groups
from brindle.llm.packing import pack
from brindle.llm.quality import quality_scores
from brindle.llm.queries import learnable_labels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _numbered(docs: DataFrame, name: str) -> tuple[Scratch, DataFrame]:
    """docs with a row number of its own for each row, written so that it stays the same."""
    scratch = Scratch(docs.sparkSession, name)
    return scratch, scratch.save(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns as op9 does, from the labels of sf_dir."""
    scored = quality_scores(spark, docs.select(*COLUMNS), learnable_labels(spark, sf_dir), keep=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, keeps the one with the largest doc_id, and of repeated rows one."""
    _, rows = _numbered(docs, "stage-exact")
    found = exact_dedup(spark, rows.withColumn("key", F.struct("doc_id", "row")), id_col="key")
    kept = found.where("kept").select(F.col("key.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by 0.8 or more of their five-word shingles, keeps the first."""
    _, rows = _numbered(docs, "stage-near")
    return rows.join(near_groups(spark, rows, "row"), "row", "left_anti").select(*COLUMNS)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, lang, source, found): a row for each time that the mix takes words of a document, with those words."""
    for batch in batches:
        rows, texts = [], []
        for k, (text, found) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())):
            words = None
            for copy in range(1, max(x["times"] for x in found) + 1):
                spans: list[list[int]] = []
                for a, b in sorted((x["first"], x["last"]) for x in found if x["times"] >= copy):
                    if spans and spans[-1][1] == a:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
                words = words or [m.span() for m in WORD.finditer(text)]
                whole = spans == [[0, len(words)]]
                rows.append(k)
                texts.append(text if whole else "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in spans))
        at = pa.array(rows, pa.int64())
        new = [batch.column(0).take(at), pa.array(texts, pa.string()), batch.column(2).take(at), batch.column(3).take(at), pa.array(list(map(len, texts)), pa.int64())]
        yield pa.RecordBatch.from_arrays(new, list(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: a document comes once for each time that blocks of it are drawn, with the words drawn.

    Blocks next to each other stay one passage of the text; a document drawn whole stays as it is.
    """
    mixture = mix_sources(spark, docs, keep=("text", "lang"))
    times = mixture.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
    drawn = mixture.parts.where("size > 0").join(times, ["src", "block"]).groupBy("row").agg(F.collect_list(F.struct("first", "last", "times")).alias("found"))
    key = F.shiftleft(F.col("part").cast("long"), 40).bitwiseOR(F.col("nth"))
    rows = mixture.rows.select(key.alias("row"), F.col("id").alias("doc_id"), "kept.text", "kept.lang", "source")
    return rows.join(drawn, "row").select("doc_id", "text", "lang", "source", "found").mapInArrow(_copies, SCHEMA)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack(spark, docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", packed)]

#: Classifiers, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; what each returns is written and read again."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
