"""Splits, balancing and sampling by hashes, so that draws are the same on any cluster."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: Bins that a round of counting looks at, and rows of a bin that are sorted.
BINS, SORTED = 1024, 10_000


def random_select(rows: DataFrame, n: int, seed: int, namespace: str, index: str = "index") -> DataFrame:
    """n rows in hash order; only partial top n are exchanged."""
    return rows.withColumn("rank", X.stable_rank(seed, namespace, F.col(index))).orderBy("rank", index).limit(n)


def stratified(rows: DataFrame, stratum: str, shares: dict[str, float], seed: int, index: str = "index") -> DataFrame:
    """Splits in hash order inside each stratum by floor(n * share); the last split takes the rest."""
    w = Window.partitionBy(stratum).orderBy(X.stable_rank(seed, "split", F.col(index)), index)
    n = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("__of"))
    placed = rows.withColumn("__k", F.row_number().over(w)).join(n, stratum)
    names = list(shares)
    split, upto = F.when(F.lit(False), ""), F.lit(0)
    for name in names[:-1]:
        upto = upto + F.floor(F.col("__of") * shares[name])
        split = split.when(F.col("__k") <= upto, name)
    return placed.withColumn("split", split.otherwise(names[-1])).drop("__k", "__of")


def holdout(rows: DataFrame, share: float, seed: int, index: str = "index") -> DataFrame:
    """A share of all rows in hash order, one at least, is "val". The cut is found by counting ranks in bins, ever finer
    ones around it, until the bin that it falls in holds few rows; only these are sorted. Rows of one index share a rank."""
    ranked = rows.withColumn("__rank", X.stable_rank(seed, "holdout", F.col(index)))
    n = ranked.count()
    left = max(1, int(n * share)) if n else 0
    low, width = 0, 1 << 64
    inside = ranked.select("__rank", index)
    while width >= BINS:
        step = width // BINS
        # Integral division of decimals is exact; a quotient could be rounded up to the next bin.
        bins = inside.groupBy(F.expr(f"CAST((__rank - {low}BD) div {step}BD AS INT)").alias("bin")).count().orderBy("bin").collect()
        at = next((k for k, total in enumerate(itertools.accumulate(b["count"] for b in bins)) if total >= left), None)
        if at is None:
            break
        left -= sum(b["count"] for b in bins[:at])
        low, width = low + bins[at].bin * step, step
        inside = inside.where(f"__rank >= {low}BD AND __rank < {low + width}BD")
        if bins[at]["count"] <= SORTED:
            break
    last = inside.orderBy("__rank", index).limit(left).agg(F.max(F.struct("__rank", index)).alias("m"))
    before = F.struct("__rank", F.col(index)) <= F.col("m")
    return ranked.crossJoin(F.broadcast(last)).withColumn("split", F.when(before, "val").otherwise("train")).drop("m", "__rank")


def oversample(rows: DataFrame, labels: str, multipliers: dict[str, int]) -> DataFrame:
    """Each row as often as the largest multiplier of its labels says; `copy` counts from 0."""
    times = F.create_map(*[F.lit(x) for pair in multipliers.items() for x in pair])
    most = F.array_max(F.transform(labels, lambda c: F.coalesce(F.try_element_at(times, c), F.lit(1))))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(most, F.lit(1)), F.lit(1)) - 1)))


def quota(rows: DataFrame, group: str, quotas: DataFrame, seed: int, index: str = "index") -> DataFrame:
    """Of each group as many rows, in hash order, as (group, quota) allows."""
    w = Window.partitionBy(group).orderBy(X.stable_rank(seed, "quota", F.col(index)), index)
    return rows.join(quotas, group).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= F.col("quota")).drop("__k", "quota")


def dominant(rows: DataFrame, by: str, category: str, order: str) -> DataFrame:
    """Per group the most frequent category; ties go to the one that comes first, then to the last by name."""
    n = rows.groupBy(by, category).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return n.groupBy(by).agg(F.max_by(category, F.struct("n", -F.col("first"), F.col(category))).alias(category))


def _hash(seed: int, namespace: str, index: int) -> int:
    """`text.stable_rank` of one index."""
    return int.from_bytes(hashlib.sha256(f"{seed}\0{namespace}\0{index}".encode()).digest()[:8], "big")


def _cover(pool: pd.DataFrame, targets: list[str], available: dict[str, int], n: int, seed: int, namespace: str) -> Iterable[int]:
    """Greedy cover: the least covered target in turn (ties: the rarest of the pool, then by hash), its row of the largest
    sum of 1 / (1 + covered) over its targets, then of the lowest rank; rows in order of `filler` fill up."""
    queues: dict[frozenset, list] = {}
    for row in pool.sort_values(["rank", "index"]).itertuples(index=False):
        if len(row.held):
            queues.setdefault(frozenset(row.held), []).append((int(row.rank), int(row.index)))
    heads = dict.fromkeys(queues, 0)
    tie = {t: (available.get(t, 0), _hash(seed, f"{namespace}:target", k)) for k, t in reversed(list(enumerate(targets)))}
    covered, out = dict.fromkeys(targets, 0), []
    while len(out) < n:
        open_ = [held for held, q in queues.items() if heads[held] < len(q)]
        if not open_:
            break
        target = min(set().union(*open_), key=lambda t: (covered[t], *tie[t]))
        # The gain depends on a row's targets only, so the first free row of each set of targets stands for all of them.
        gain = lambda held: math.fsum(1 / (1 + covered[t]) for t in held)
        rank = lambda held: queues[held][heads[held]]
        best = min((held for held in open_ if target in held), key=lambda held: (-gain(held), *rank(held)))
        out.append(rank(best)[1])
        heads[best] += 1
        for t in best:
            covered[t] += 1
    used = set(out)
    rest = [int(i) for i in pool.sort_values(["filler", "index"])["index"] if int(i) not in used]
    return out + rest[: n - len(out)]


def balanced_select(pool: DataFrame, targets: list[str], n: int, seed: int, namespace: str) -> DataFrame:
    """n rows that cover the targets evenly. pool: (index, labels array<string>), an index once.

    The choice is sequential, so it runs on finalists: the first n rows in hash order of each distinct set of targets, and
    the first n of all in the fillers' order. Rows of equal targets have equal gains and go by hash, and no more than n
    are chosen, so this is exact.
    """
    held = F.array_sort(F.array_distinct(F.array_intersect("labels", F.array(*[F.lit(t) for t in targets]).cast("array<string>"))))
    ranked = pool.select(
        "index", F.coalesce(held, F.array().cast("array<string>")).alias("held"), X.stable_rank(seed, namespace, F.col("index")).alias("rank"), X.stable_rank(seed + 1, f"{namespace}:filler", F.col("index")).alias("filler")
    )
    # As many rows as targets.
    available = {r.t: r["count"] for r in ranked.select(F.explode("held").alias("t")).groupBy("t").count().collect()}
    w = Window.partitionBy("held").orderBy("rank", "index")
    few = ranked.where(F.size("held") > 0).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")
    finals = few.unionByName(ranked.orderBy("filler", "index").limit(n)).dropDuplicates(["index"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        got = list(_cover(pdf, targets, available, n, seed, namespace))
        return pd.DataFrame({"turn": range(len(got)), "index": got})

    return finals.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(choose, "turn long, index long")


def hard_and_general(pool: DataFrame, targets: list[str], total: int, hard_share: float, seed: int, namespace: str) -> DataFrame:
    """(index, part): a share of `total` rows that cover the targets evenly ("hard"), the others from the rest in hash
    order ("general"). pool: (index, labels), an index once. Too few rows for the second part are an error."""
    hard = balanced_select(pool, targets, round(total * hard_share), seed, f"{namespace}:hard").select("index", F.lit("hard").alias("part"))
    many = total - round(total * hard_share)
    rest = random_select(pool.select("index").join(hard, "index", "left_anti"), many, seed + 7, f"{namespace}:general")
    if rest.count() < many:
        raise ValueError(f"{namespace}: too few rows for the general part")
    return hard.unionByName(rest.select("index", F.lit("general").alias("part")))


# Bonus for each category of a row, and the objects beyond which each costs.
PER_CATEGORY, PER_OBJECT, FREE_OBJECTS = 0.05, 0.002, 12


def benchmark_select(rows: DataFrame, n: int) -> DataFrame:
    """(name, turn): n rows chosen one by one by what rare categories they add. rows: (name, categories array<string>, objects).

    A category weighs 1 / sqrt(rows with it), less with each chosen row that has it; rows with many objects lose a little.
    Ties: more categories, fewer objects, the last name. Rows of equal categories rank by objects and name alone, so the
    first n of each distinct set of categories are enough, and the choice is exact.
    """
    held = rows.select("name", F.array_sort(F.array_distinct("categories")).alias("held"), F.col("objects").cast("long").alias("objects"))
    # As many rows as categories.
    weight = {r.c: 1 / math.sqrt(r["count"]) for r in held.select(F.explode("held").alias("c")).groupBy("c").count().collect()}
    w = Window.partitionBy("held").orderBy("objects", F.desc("name"))
    few = held.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        decks = {c: list(g.itertuples(index=False)) for c, g in pdf.assign(held=pdf["held"].map(tuple)).sort_values("k").groupby("held")}
        chosen, at, out = dict.fromkeys(weight, 0), dict.fromkeys(decks, 0), []

        def worth(c):
            top = decks[c][at[c]]
            score = sum(weight[x] / (1 + chosen[x]) for x in c) + PER_CATEGORY * len(c) - PER_OBJECT * max(0, top.objects - FREE_OBJECTS)
            return round(score, 8), len(c), -top.objects, top.name

        while len(out) < n and (open_ := [c for c in decks if at[c] < len(decks[c])]):
            best = max(open_, key=worth)
            out.append(decks[best][at[best]].name)
            at[best] += 1
            for x in best:
                chosen[x] += 1
        return pd.DataFrame({"name": out, "turn": range(len(out))})

    return few.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(choose, "name string, turn long")


def split_families(families: DataFrame, shares: dict[str, float], seed: int) -> DataFrame:
    """(family, n, split): families, largest first, go to the split that is furthest below its share; ties by name of
    the split. One row per family; the fold is over families, whole drawings stay together. families: (family, n)."""
    names = list(shares)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        total = float(pdf["n"].sum())
        have = dict.fromkeys(names, 0.0)
        out = []
        for n in pdf.sort_values(["n", "rank"], ascending=[False, True])["n"]:
            best = max(names, key=lambda s: (shares[s] * total - have[s] if shares[s] else float("-inf"), -names.index(s)))
            have[best] += n
            out.append(best)
        done = pdf.sort_values(["n", "rank"], ascending=[False, True]).assign(split=out)
        return done[["family", "n", "split"]]

    ranked = families.withColumn("rank", X.stable_rank(seed, "family", F.col("family")).cast("double"))
    return ranked.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(assign, "family string, n long, split string")
