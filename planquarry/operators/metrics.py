"""Detection metrics as column expressions and aggregates over match counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp, fn), recall(tp, fp, fn)
    return ratio(2 * p * r, p + r)


def with_prf(stats: DataFrame) -> DataFrame:
    c = [F.col(x) for x in ("tp", "fp", "fn")]
    return stats.withColumns({"precision": precision(*c), "recall": recall(*c), "f1": f1(*c), "mean_iou": ratio(F.col("iou_sum"), c[0])})


def summary(stats: DataFrame, seen_only: str = "tp + fp + fn > 0") -> DataFrame:
    """One row: micro P/R/F1 over all categories, macro F1 over the categories that `seen_only` admits."""
    per = with_prf(stats)
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    sums = per.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.sum("iou_sum").alias("iou_sum"), F.avg(F.expr(f"IF({seen_only}, f1, NULL)")).alias("macro_f1"))
    return with_prf(sums)


def merge_stats(*parts: DataFrame, by: str = "cat") -> DataFrame:
    """Sum of partial statistics; the engine's own partial aggregation does the same inside one query."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "iou_sum")])


def cad_score(feature_f1, size, iou, strict, layout_f1, layout_iou) -> Column:
    """0.75 of features (0.55 F1, 0.20 size, 0.15 overlap, 0.10 strict F1) and 0.25 of layout (0.85 F1, 0.15 overlap);
    a part that is null leaves its weight to the other."""
    feature = 0.55 * feature_f1 + 0.20 * size + 0.15 * iou + 0.10 * strict
    layout = 0.85 * layout_f1 + 0.15 * layout_iou
    return F.coalesce(0.75 * feature + 0.25 * layout, feature, layout, F.lit(0.0))


def quality(f1_, size: Column | None, iou: Column, empty: Column) -> Column:
    score = 0.85 * f1_ + 0.15 * iou if size is None else 0.60 * f1_ + 0.25 * size + 0.15 * iou
    return F.when(empty, 1.0).otherwise(score)


def penalised_quality(base: Column, n_p: Column, n_g: Column, matched: Column, weight: float = 0.05) -> Column:
    n = F.greatest(n_p, n_g)
    return F.when(n == 0, 1.0).otherwise((base - weight * (n_p - matched) - weight * (n_g - matched)) / n)


def refined_reward(initial: Column, refined: Column) -> Column:
    """The refined score plus half the gain (clipped to 0.2), inside 0 and 1, to four places (half to even)."""
    gain = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), refined - initial))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), refined + 0.5 * gain)), 4)


def size_accuracy(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def index_percentile(values: Column, share: float) -> Column:
    """The value at index floor(n * share) of the sorted values (the last one for share 1); no interpolation."""
    s = F.array_sort(values)
    return F.try_element_at(s, F.least(F.size(s), F.floor(F.size(s) * share).cast("int") + 1))


def exact_rates(passed: DataFrame, by: str = "cat") -> DataFrame:
    """(by, passed, total, rate) of rows (by, exact boolean): a null counts as not exact."""
    fine = F.coalesce(F.col("exact"), F.lit(False)).cast("long")
    sums = passed.groupBy(by).agg(F.sum(fine).alias("passed"), F.count(F.lit(1)).alias("total"))
    return sums.withColumn("rate", F.col("passed") / F.col("total"))
