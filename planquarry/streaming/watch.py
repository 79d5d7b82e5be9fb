"""Watching results as they arrive: the latest row per checkpoint, ranked; runs of low readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

RESULT = "checkpoint string, step long, precision double, recall double, f1 double, avg_quality double"


def ranked(results: DataFrame) -> DataFrame:
    """The last row of each checkpoint (by step, then f1), best first. Checkpoints are few."""
    last = results.groupBy("checkpoint").agg(F.max_by(F.struct(*[c for c in results.columns if c != "checkpoint"]), F.struct("step", "f1")).alias("r"))
    flat = last.select("checkpoint", "r.*")
    order = [F.desc("f1"), F.desc("avg_quality"), F.desc("precision"), F.desc("recall"), F.desc("checkpoint")]
    return flat.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def watch(spark: SparkSession, source: str, done: str, ranking: str, checkpoint: str, files: int = 10, every: str | None = None) -> StreamingQuery:
    """Append each new result once to `done` and rewrite the ranking after every batch. Without `every` the query
    handles what is there and ends. A batch that is run again after a failure overwrites its own folder, so `done`
    holds each row once."""
    stream = spark.readStream.schema(RESULT).option("maxFilesPerTrigger", files).json(source)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{done}/batch={number}")
        whole = session.read.option("basePath", done).parquet(done).drop("batch")
        ranked(whole).write.mode("overwrite").parquet(ranking)

    writer = stream.dropDuplicates(["checkpoint", "step"]).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per window and type, for streams (with a watermark) and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def low_runs(readings: DataFrame, threshold: float, length: int, by: str, order: str, value: str = "value") -> DataFrame:
    """Where a series has been under `threshold` for `length` readings in a row: (by, order, run)."""
    w = Window.partitionBy(by).orderBy(order)
    low = F.coalesce(F.col(value) < threshold, F.lit(False))
    block = F.sum((~low).cast("int")).over(w)
    marked = readings.withColumn("__low", low).withColumn("__b", block)
    run = F.sum(F.col("__low").cast("int")).over(Window.partitionBy(by, "__b").orderBy(order))
    return marked.withColumn("run", run).where(F.col("__low") & (F.col("run") >= length)).select(by, order, "run")
