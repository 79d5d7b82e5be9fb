"""Sinks: JSON lines, atomic single files with a digest, batches, ordered results."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, nulls kept, by all executors; the committer makes it all or nothing."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def content_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever the order of its rows: exact sums of two halves of each row's SHA-256."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count(F.lit(1)), half(1), half(16)).first()
    return n, hashlib.sha256(f"{n}|{a}|{b}".encode()).hexdigest()


def write_one_file(df: DataFrame, path: str, order: list[str]) -> tuple[int, str]:
    """Sorted JSON lines in one local file, replaced at once; (rows, SHA-256 of its bytes). For reports and manifests:
    rows stream through the driver one partition at a time."""
    digest, n = hashlib.sha256(), 0
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("wb", dir=folder, delete=False) as f:
        for row in df.orderBy(*order).toJSON().toLocalIterator():
            line = row.encode() + b"\n"
            f.write(line)
            digest.update(line)
            n += 1
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)
    return n, digest.hexdigest()


def write_json(value, path: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(f.name, path)


def write_batches(df: DataFrame, path: str, position: str, size: int) -> None:
    """Folders batch=0, 1, ... of `size` positions each; a batch that is there already is left alone."""
    spark = df.sparkSession
    placed = df.withColumn("batch", F.floor(F.col(position) / size))
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where) if "=" in s.getPath().getName()] if fs.exists(where) else []
    fresh = placed.where(~F.col("batch").isin(there)) if there else placed
    fresh.write.mode("append").partitionBy("batch").json(path)


def in_reference_order(results: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Results in the order of the reference's first mention of their key; unknown keys at the end, by key."""
    first = reference.groupBy(key).agg(F.min("pos").alias("__at"))
    return results.join(first, key, "left").orderBy(F.asc_nulls_last("__at"), key).drop("__at")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose keys the table does not hold yet."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)
