"""Shared pieces: table access, tables written to cut lineage, connected components."""

from __future__ import annotations

import ctypes
import functools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of an Arrow batch: texts may be long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and about BATCH_BYTES bytes if they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def _release() -> None:
    """Give freed memory back: Python workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def frugal(run):
    """For functions of Arrow batches: memory goes back when a task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def frugal_group(run):
    """For functions of a group: memory goes back after each."""

    @functools.wraps(run)
    def wrapped(key, rows):
        out = run(key, rows)
        _release()
        return out

    return wrapped


def give_back(spark: SparkSession) -> None:
    """Let the executors collect garbage between two stages, so that their heaps shrink before the next one grows its own.

    One short task per slot; an executor that gets none keeps its heap, which costs memory and nothing else."""
    slots = max(spark.sparkContext.defaultParallelism, 1)
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).where("done <> ''").count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session without one (tests) gets a local folder."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/planquarry-shared"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, total_bytes: int, each: int) -> int:
    """Partitions of about `each` bytes, at least the session's own count."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(total_bytes or 0) // each))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, comp), comp the smallest node reached.

    Alternates large-star and small-star steps until nothing changes; each step is two
    min-aggregates and two joins, so no neighbourhood is gathered in one place. Nodes without
    links are absent. Self links and repeated links are allowed.
    """
    e = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc"
    )
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "cc")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                )
            ).alias("s")
        )
        e = written(small.select("s.a", "s.b").where("a <> b").distinct(), "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def roots(pointers: DataFrame) -> DataFrame:
    """(node, comp) of a forest of pointers (a, b): each a points at one b, never in a circle. Pointer doubling."""
    p = written(pointers.select("a", "b"), "roots")
    while True:
        further = p.select(F.col("a").alias("b"), F.col("b").alias("c"))
        p = written(p.join(further, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "roots")
        if not p.where("moved").limit(1).collect():
            break
        p = p.select("a", "b")
    tops = p.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return p.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(tops)


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) after more links (a, b) between nodes; nodes in no component stand for themselves."""
    of = lambda end: known.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")
    )
    joined = components(between)
    moved = written(joined.withColumnRenamed("node", "old").withColumnRenamed("comp", "new"), "merged")
    kept = known.join(moved, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    # Nodes that were in no component and now are.
    fresh = moved.join(known.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("comp"))
    return written(kept.unionByName(fresh), "merged")
