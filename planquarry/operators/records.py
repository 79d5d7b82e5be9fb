"""Joining, merging, deduplicating and aligning records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.shared import written


def align(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each true record to the prediction that shares its earliest key; a prediction serves once, the first record
    that can't do better earlier. Both: (pos, keys array<string>). Rows (truth, prediction or null, key).

    A prediction owns a key if it is the first to name it. Taking records in order, each choosing its best free
    prediction, is a stable matching with one order on all predictions' side, so it is found by rounds of proposals:
    a record asks for its best prediction that has not refused it, a prediction keeps the first asker.
    """
    own = predictions.select("pos", F.explode("keys").alias("key")).groupBy("key").agg(F.min("pos").alias("prediction"))
    asks = truth.select(F.col("pos").alias("truth"), F.posexplode("keys").alias("at", "key")).join(own, "key")
    options = written(asks.groupBy("truth", "prediction").agg(F.min(F.struct("at", "key")).alias("w")).select("truth", "prediction", "w.at", "w.key"), "align")
    while True:
        asked = options.groupBy("truth").agg(F.min(F.struct("at", "prediction", "key")).alias("p")).select("truth", "p.prediction", "p.key")
        kept = asked.groupBy("prediction").agg(F.min("truth").alias("winner"))
        refused = asked.join(kept, "prediction").where("truth <> winner").select("truth", "prediction")
        if refused.isEmpty():
            break
        options = written(options.join(refused, ["truth", "prediction"], "left_anti"), "align")
    return truth.select(F.col("pos").alias("truth")).join(asked, "truth", "left")


def merge_sources(rows: DataFrame) -> DataFrame:
    """Annotations of several sources, one per (image, category, corners to three places): its sources, task names, the
    preferred size and whether sizes conflict. rows: (image, source, task, cat, size, box)."""
    corner = F.transform("box", lambda v: F.bround(v, 3))
    sizes = F.filter(F.array_sort(F.collect_set("size")), lambda s: s != "")
    return (
        rows.groupBy("image", "cat", corner.alias("corner"))
        .agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("task")).alias("tasks"), sizes.alias("sizes"))
        .select("image", "cat", F.col("corner").alias("box"), "sources", "tasks", F.coalesce(X.prefer_size(F.col("sizes")), F.lit("")).alias("size"), (F.size("sizes") > 1).alias("conflict"))
    )


def merge_shards(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key out of shards: equal repeats are dropped, unequal ones fail the query."""
    others = [c for c in rows.columns if c not in (key, order)]
    whole = F.sha2(F.to_json(F.struct(*others)).cast("binary"), 256)
    out = rows.withColumn("__h", whole).groupBy(key).agg(
        F.min("__h").alias("lo"), F.max("__h").alias("hi"), F.min(order).alias(order), F.min_by(F.struct(*others), order).alias("r")
    )
    same = F.when(F.col("lo") == F.col("hi"), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("shards disagree on "), F.col(key).cast("string"))))
    return out.select(key, order, same.alias("r")).select(key, order, "r.*")


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key, in a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def pending(work: DataFrame, done: DataFrame, keys: list) -> DataFrame:
    """Work without a finished row."""
    return work.join(done.where("status = 'ok'").select(*keys).distinct(), keys, "left_anti")


def preference_pairs(samples: DataFrame, gap: float) -> DataFrame:
    """Per image the sample of the highest and of the lowest score, if they differ by `gap`. Ties: the first sample."""
    best = F.max_by("sample", F.struct("score", -F.col("sample")))
    worst = F.min_by("sample", F.struct("score", F.col("sample")))
    out = samples.groupBy("image").agg(best.alias("chosen"), worst.alias("rejected"), F.max("score").alias("high"), F.min("score").alias("low"))
    return out.where((F.col("high") - F.col("low") >= gap) & (F.col("chosen") != F.col("rejected")))


def projection_of(methods: Column) -> Column:
    """The one method that sources agree on, unknowns aside."""
    known = F.array_distinct(F.filter(methods, lambda m: m != "unknown"))
    return F.when(F.size(known) == 1, known[0]).otherwise("unknown")


def leaks(rows: DataFrame, family: str = "family", split: str = "split") -> DataFrame:
    """Families in more than one split."""
    return rows.groupBy(family).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def issues(rows: DataFrame, examples: int = 3) -> DataFrame:
    """(severity, code): count and the first examples in order. rows: (severity, code, detail)."""
    w = Window.partitionBy("severity", "code").orderBy("detail")
    few = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= examples)
    listed = few.groupBy("severity", "code").agg(F.array_sort(F.collect_list("detail")).alias("examples"))
    return rows.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n")).join(listed, ["severity", "code"])
