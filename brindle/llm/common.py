"""What the corpus operators share: scratch tables in the shared folder, text buffers, deterministic splits."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; one longer document still goes through whole.
CHUNK_BYTES = 4 << 20
#: Spark's own bound on an Arrow batch, so that a batch of long documents stays small in both processes.
BATCH_BYTES = "16m"
BATCH_ROWS = "4000"

_EXIT: list = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt out where the scan of a small table has fewer tasks than there are cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes and rows, unless the session has bounds of its own (other than Spark's defaults)."""
    for key, default, value in (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS)):
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where Spark runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/brindle-scratch"


class Scratch:
    """Written tables that cut lineage. They outlive executors; a rerun gets a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.tables = spark, f"{scratch_root(spark)}/brindle/{name}-{uuid.uuid4().hex}", []
        if not _EXIT:
            atexit.register(_clean)
        _EXIT.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
        """Bucketed by key: joins on it leave this table where it is."""
        table = f"brindle_{name}_{uuid.uuid4().hex}"
        writer = df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", f"{self.base}/{name}")
        writer.bucketBy(n, key).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean() -> None:
    for s in _EXIT:
        try:
            for table in s.tables:
                s.spark.sql(f"DROP TABLE IF EXISTS {table}")
            s.drop()
        except Exception:  # noqa: BLE001 - the JVM may be gone by now
            return


def remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty. offsets[i]:offsets[i+1] is row i."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]], o - o[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def rows_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as byte strings; null is empty."""
    data, offs = buffer(batch.column(batch.schema.get_field_index(name)))
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


def merged(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over each row's range, also for empty ranges."""
    out = np.zeros(len(offsets) - 1, dtype=values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out
