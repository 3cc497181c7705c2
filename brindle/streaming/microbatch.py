"""Incremental runs as Structured Streaming micro-batches over files or tables.

Each stream reads new files once (available-now), keeps its place in a checkpoint, and writes through
foreachBatch with keyed, idempotent sinks: a batch that is tried again changes nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import latest_wins, upsert
from ..sources.sinks import recover, replace


def new_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Works off what is there, batch by batch, and ends."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def upsert_into(path: str, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the latest row of each key; the same batch again gives the same table."""

    def each(batch: DataFrame, _: int) -> None:
        spark, new = batch.sparkSession, latest_wins(batch, keys, [F.col(order).desc_nulls_last(), F.xxhash64(F.struct(*batch.columns)).desc()])
        old = spark.read.parquet(path) if recover(spark, path) else None
        replace(upsert(old, new, keys, keep) if old is not None else new, path)

    return each


def notify_into(ledger: str, send: Callable[[DataFrame], None], key: str = "story_id") -> Callable[[DataFrame, int], None]:
    """A sink that sends what the ledger doesn't have, and then enters it."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if table_exists(spark, ledger):
            fresh = fresh.join(spark.read.parquet(ledger).select(key), key, "left_anti")
        fresh = fresh.persist()
        try:
            if not fresh.isEmpty():
                send(fresh)
                fresh.select(key).write.mode("append").parquet(ledger)
        finally:
            fresh.unpersist()

    return each


def unchanged(spark: SparkSession, path: str, newest: str) -> bool:
    """Whether a one-row state table holds this watermark already."""
    return table_exists(spark, path) and spark.read.parquet(path).where(F.col("newest") == newest).limit(1).count() > 0


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and values per window and type; events later than the watermark don't count."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def seen_filter(stream: DataFrame, key: str = "story_id") -> DataFrame:
    """Rows (story_id, depth, id) not seen before at their depth; roots (depth 1) always pass. State: the ids of each story."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        for rows in batches:
            marks = [f"{d}:{i}" for d, i in zip(rows["depth"], rows["id"])]
            fresh = [d == 1 or m not in seen for d, m in zip(rows["depth"], marks)]
            seen.update(marks)
            yield rows.loc[fresh, [key, "depth", "id"]]
        state.update((sorted(seen),))

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, depth int, id long", "seen array<string>", "append", "NoTimeout")


def reservations(stream: DataFrame, limit: int, window_seconds: int = 60) -> DataFrame:
    """(gateway, id, admitted): calls in order of time; one is admitted if the tokens admitted in the window before it and its own stay
    within the limit, or if the window is empty. State: each gateway's admitted calls of the last window."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = deque(zip(*state.get)) if state.exists else deque()
        used = sum(n for _, n in held)
        for rows in batches:
            out = []
            for at, i, n in sorted(zip(rows["at"], rows["id"], rows["tokens"])):
                while held and held[0][0] <= at - window_seconds:
                    used -= held.popleft()[1]
                fits = not held or used + n <= limit
                if fits:
                    held.append((int(at), int(n)))
                    used += int(n)
                out.append((k[0], i, fits))
            yield pd.DataFrame(out, columns=["gateway", "id", "admitted"])
        state.update(([t for t, _ in held], [n for _, n in held]))

    return stream.groupBy("gateway").applyInPandasWithState(step, "gateway string, id long, admitted boolean", "times array<long>, tokens array<long>", "append", "NoTimeout")
