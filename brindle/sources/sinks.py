"""Sinks: versioned atomic tables, writes that skip unchanged content, exports, archives and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> int:
    """A hash of a table's rows in any order: a sum of row hashes, in one aggregate."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    value = df.agg(F.sum(row.cast("decimal(38,0)")), F.count("*")).first()
    return hash((int(value[0] or 0), value[1]))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def recover(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; one that a replace() had moved aside when it was cut off comes back. For writers, before they read."""
    fs, at = _fs(spark, path)
    if not fs.exists(at) and fs.exists(aside := _fs(spark, f"{path}.old")[1]) and not fs.rename(aside, at):
        raise OSError(f"{path}.old can't be moved back")
    return fs.exists(at)


def replace(df: DataFrame, path: str) -> None:
    """Writes beside the table, moves the table aside and the new one into place. df may read the table itself.

    At each moment a whole table is at path or at path.old, which recover() brings back; the table aside is deleted
    only when the new one is in place. A reader that comes between the renames finds no table and tries again.
    """
    spark, new, old = df.sparkSession, f"{path}.new", f"{path}.old"
    fs, at = _fs(spark, path)
    there = recover(spark, path)
    df.write.mode("overwrite").parquet(new)
    if there:
        fs.delete(_fs(spark, old)[1], True)  # left over from a run that was cut off after its last rename
        _move(fs, at, _fs(spark, old)[1])
    _move(fs, _fs(spark, new)[1], at)
    fs.delete(_fs(spark, old)[1], True)


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} can't be moved to {target}")


def put(df: DataFrame, path: str, skip_unchanged: bool = False) -> bool:
    """An object's content: overwritten unless the caller asks to skip equal content."""
    if skip_unchanged:
        return replace_if_changed(df, path)
    replace(df, path)
    return True


def replace_if_changed(df: DataFrame, path: str) -> bool:
    """replace(), unless the table's rows are the same already."""
    spark = df.sparkSession
    if recover(spark, path) and content_hash(spark.read.parquet(path).select(*df.columns)) == content_hash(df):
        return False
    replace(df, path)
    return True


def append(df: DataFrame, path: str) -> bool:
    """Appends; an empty batch writes nothing."""
    if df.isEmpty():
        return False
    df.write.mode("append").parquet(path)
    return True


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def archive_split(rows: DataFrame, day: Column, as_of: str, keep_days: int = 14) -> tuple[DataFrame, DataFrame]:
    """(stays, goes): rows whose day is more than keep_days before as_of go, with archive references."""
    old = day < F.date_sub(F.lit(as_of).cast("date"), keep_days)
    goes = rows.where(old).withColumn("ref", F.concat(F.lit("archive/"), F.date_format(day, "yyyy-MM-dd"), F.lit("#"), F.col("ref")))
    return rows.where(~F.coalesce(old, F.lit(False))), goes


def write_archive(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path)


def report(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of a small result's first rows."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
