"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by the key (hash of the text, hash of the row id, number of the row). Splitters between shards
are found by counting exact bytes below candidate key boundaries in all partitions, and by
refining the candidates around each target until a splitter meets the tolerance; then rows
are numbered with one exchange. Splitters fall between different text hashes where one of
these meets the tolerance, so equal texts stay in one shard; a group of equal texts that is
itself larger than the tolerance is cut by the row id's hash, and rows of one text and id by their numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table, written

LAW = "bytes"
LOW = -(2**63)
#: Key bits looked at per round: a round counts the bytes in at most 2**BITS bins for each open splitter.
BITS = 10


def _search(rows: DataFrame, column: str, targets: list[int], allowed: float) -> list[tuple[int, int, bool]]:
    """For each target byte count (splitter, exact bytes with key < splitter, within `allowed`?).

    Candidate boundaries are the bins of the next BITS key bits inside the bin that the target falls in.
    Where that bin holds one key only, the splitter is this key and the answer is not within `allowed`.
    """
    key = F.col(column).bitwiseXOR(F.lit(LOW))  # unsigned order
    found: list[tuple[int, int, bool] | None] = [None] * len(targets)
    place = [(None, 0)] * len(targets)  # prefix of the bin that the target falls in, bytes below that bin
    used = 0
    while live := [i for i, f in enumerate(found) if f is None]:
        prefix = lambda bits: F.shiftrightunsigned(key, 64 - bits) if bits < 64 else key
        inside = rows if used == 0 else rows.where(prefix(used).isin(sorted({place[i][0] for i in live})))
        taken = min(64, used + BITS)
        parent = F.lit(None).cast("long") if used == 0 else prefix(used)
        bins = (
            inside.groupBy(parent.alias("parent"), prefix(taken).alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.min(column).alias("lo"), F.max(column).alias("hi"))
            .collect()
        )
        children: dict = {}
        for x in sorted(bins, key=lambda x: x.lo):
            children.setdefault(x.parent, []).append(x)
        used = taken
        for i in live:
            within, below = place[i]
            edges = []
            for x in children.get(within, []):
                edges.append((abs(below - targets[i]), x.lo, below))
                if below <= targets[i] < below + x.bytes:
                    place[i], single = (x.bin, below), (x.lo, below) if x.lo == x.hi else None
                below += x.bytes
            if not edges:
                found[i] = (LOW, 0, True)
                continue
            off, splitter, at = min(edges)
            if off <= allowed:
                found[i] = (splitter, at, True)
            elif targets[i] >= below:
                found[i] = (children[within][-1].hi + 1, below, True)
            elif single:
                found[i] = (*single, False)
    return found


def shard(
    docs: DataFrame, shards: int = 16, tolerance: float = 0.002, text: str = "text", row_id: str = "doc_id"
) -> DataFrame:
    """Add size, text_crc32, shard and slot to (row_id); sizes per shard equal within `tolerance` of one shard.

    A null text has no bytes and size 1; null ids are ids like others; repeated rows are separate rows, and many of them
    are spread over shards. An empty table gives no rows. Shards are key ranges; slots number a shard's rows from 0
    without gaps. A splitter is closer than `tolerance` times a shard's size to its target unless a single row is larger
    than that. Shards depend on texts and ids only, but for rows equal in both; slots also on the order of the input.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = written(
        docs.select(
            F.col(row_id).alias("row_id"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body).cast("long").alias("text_crc32"),
            F.xxhash64(body).alias("h"),
            F.xxhash64(F.lit(17), F.col(row_id)).alias("r"),
            F.xxhash64(F.monotonically_increasing_id()).alias("u"),
        ),
        "shard",
    )
    total = int(rows.agg(F.sum("size")).first()[0] or 0)
    allowed = tolerance * total / shards
    targets = [total * k // shards for k in range(1, shards)]
    cuts: list[tuple[int, int, int]] = []
    for target, (h, below, near) in zip(targets, _search(rows, "h", targets, allowed), strict=True):
        r = u = LOW
        if not near:
            # No boundary between text hashes is near enough: the group that the target falls in is cut by row.
            group = rows.where(F.col("h") == F.lit(h))
            r, under, near = _search(group, "r", [target - below], allowed)[0]
            if not near:
                u = _search(group.where(F.col("r") == F.lit(r)), "u", [target - below - under], allowed)[0][0]
        cuts.append((h, r, u))
    cuts.sort()
    after = lambda c, x: F.col(c) > F.lit(x)
    same = lambda c, x: F.col(c) == F.lit(x)
    ge = [after("h", h) | (same("h", h) & (after("r", r) | (same("r", r) & (F.col("u") >= F.lit(u))))) for h, r, u in cuts]
    number = F.lit(0)
    for g in ge:
        number = number + g.cast("int")
    # Slots: rows are dealt to many sub-buckets of each shard, counted, and numbered inside their bucket.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    placed = rows.withColumn("shard", number.cast("int")).withColumn("bucket", F.pmod(F.col("u"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(
        "shard",
        "bucket",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"),
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("row_id", "h")
    numbered = placed.withColumn("k", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "bucket"]).select(
        F.col("row_id").alias(row_id), "size", "text_crc32", "shard", (F.col("k") + F.col("start")).alias("slot")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in 16 shards of near equal bytes; see `shard` for nulls, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )


QUERIES = {"op7_sharding": op7_sharding}
ORACLE_SQL: dict[str, str] = {}
