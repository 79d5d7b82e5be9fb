"""A corpus pipeline over `documents`: quality, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planquarry.llm import ngram_join, packing, quality, repeats
from planquarry.llm.bpe import vocabulary
from planquarry.llm.common import give_back, small_batches, table, written

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels outside the held-out fold. Null and empty texts are
    scored as texts without words; repeated rows are judged alike; an empty table gives no rows."""
    give_back(spark)
    machine = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.fold()))
    return quality.keep_good(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of repeated rows one."""
    small_batches(spark)
    give_back(spark)
    groups = ngram_join.jaccard_components(docs)
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    rows = docs.join(kept, docs.doc_id.cast("long").eqNullSafe(kept.kept_id), "left_semi")
    return rows.withColumn("__n", F.row_number().over(same)).where("__n = 1").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of long passages that start earlier elsewhere; n_chars follows the text."""
    small_batches(spark)
    give_back(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = repeats.cut_repeats(docs, keep_text=True, extra=tuple(others)).withColumn("text", F.col("kept_text"))
    if "n_chars" in others:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens. Null and empty texts are their end id; repeated rows are
    packed each; an empty table gives no rows."""
    small_batches(spark)
    give_back(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out, "pipeline") if k < len(STAGES) - 1 else out
    return docs
