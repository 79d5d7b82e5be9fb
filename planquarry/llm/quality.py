"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

Every word occurrence is a feature of value 1 / (words of the text) at its hash; every statistic is a feature
of value 1 at the bin it falls in. The score is the logistic of

    bias + sum w_i x_i + 1/2 sum_f [ (sum v_if x_i)^2 - sum (v_if x_i)^2 ]

so all pairs interact, in time linear in the words. Labels, language, source and ids are no features. The model
is fitted on at most SAMPLE labelled rows (a documented bound), drawn by the hash of their ids among the
training fold; all rows are scored, over their whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table
from .textblocks import blocks, words

SAMPLE = 12_000
BUCKETS = 1 << 12
FACTORS = 6
BINS = 8
EPOCHS = 6
THRESHOLD = 0.7
_CLASSES = np.full(256, 6, np.int64)  # others: punctuation and controls
_CLASSES[97:123] = 0
_CLASSES[65:91] = 1
_CLASSES[48:58] = 2
_CLASSES[[9, 11, 12, 13, 32]] = 3
_CLASSES[10] = 4
_CLASSES[128:] = 5
STATS = 16


def _runs(data: np.ndarray, offsets: np.ndarray):
    """(statistics per document, bucket of each word, words before each document)."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 7 + _CLASSES[data], minlength=n * 7).reshape(n, 7)
    starts, ends, h, at = words(data, offsets)
    count = np.diff(at)
    many = np.maximum(count, 1)
    of = np.repeat(np.arange(n), count)
    per = lambda x: np.bincount(of, x, minlength=n) / many
    same1, same2 = np.zeros(len(h)), np.zeros(len(h))
    same1[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    same2[2:] = (h[2:] == h[:-2]) & (of[2:] == of[:-2])
    length = ends - starts
    last, before, first = data[ends - 1], data[np.maximum(ends - 2, starts)], data[starts]
    marks = _CLASSES[last] == 6
    ordered = np.sort(h ^ np.zeros(1, np.uint64)) if n == 1 else h[np.lexsort((h, of))]
    repeated = np.zeros(len(h))
    repeated[1:] = (ordered[1:] == ordered[:-1]) & (of[1:] == of[:-1])
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 5], 1)
    total = np.maximum(size, 1)
    stats = np.stack(
        [
            np.log1p(size),
            kinds[:, 1] / letters,
            kinds[:, 5] / letters,
            kinds[:, 2] / total,
            kinds[:, 3] / total,
            kinds[:, 4] / np.maximum(count, 1),
            kinds[:, 6] / total,
            per(length),
            np.sqrt(np.maximum(per(length.astype(float) ** 2) - per(length) ** 2, 0)),
            per(same1),
            per(same2),
            per(repeated),
            per(marks),
            per(marks & (_CLASSES[before] == 6)),
            per(_CLASSES[first] == 6),
            per((length == 1) & marks),
        ],
        axis=1,
    )
    return stats, (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), at


class Machine:
    """Weights of a factorisation machine; features 0..BUCKETS-1 are words, the rest bins of statistics."""

    def __init__(self, edges: np.ndarray, seed: int = 3):
        self.edges = edges  # (STATS, BINS - 1) ascending bin bounds
        size = BUCKETS + STATS * BINS
        self.bias = 0.0
        self.w = np.zeros(size, np.float64)
        self.v = np.random.RandomState(seed).normal(0, 0.05, (size, FACTORS))

    def bins(self, stats: np.ndarray) -> np.ndarray:
        found = [np.searchsorted(self.edges[k], stats[:, k], "left") for k in range(STATS)]
        return BUCKETS + np.arange(STATS) * BINS + np.stack(found, axis=1)

    def sums(self, bins, bucket, at):
        """Per document: linear part, sum of v x, sum of (v x)^2 over all factors."""
        n = len(at) - 1
        many = np.maximum(np.diff(at), 1)
        both = np.concatenate([self.w[:BUCKETS, None], self.v[:BUCKETS], (self.v[:BUCKETS] ** 2).sum(1)[:, None]], axis=1)
        mean = np.zeros((n, FACTORS + 2))
        full = np.diff(at) > 0
        if full.any():
            mean[full] = np.add.reduceat(both[bucket], at[:-1][full], axis=0)
        mean /= many[:, None]
        linear = mean[:, 0] + self.w[bins].sum(1)
        s = mean[:, 1:-1] + self.v[bins].sum(1)
        q = mean[:, -1] / many + (self.v[bins] ** 2).sum((1, 2))
        return linear, s, q

    def score(self, stats, bucket, at) -> np.ndarray:
        linear, s, q = self.sums(self.bins(stats), bucket, at)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + ((s**2).sum(1) - q) / 2, -30, 30)))


def fit(rows: list[tuple], seed: int = 3) -> Machine:
    """rows: (label, statistics, distinct buckets, their counts) of each training text. AdaGrad on the logistic loss."""
    if not rows:
        return Machine(np.zeros((STATS, BINS - 1)))
    stats = np.array([r[1] for r in rows])
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    m = Machine(np.ascontiguousarray(edges), seed)
    label = np.array([r[0] for r in rows], np.float64)
    share = (label.sum() + 1) / (len(label) + 2)
    m.bias = float(np.log(share / (1 - share)))
    bins = m.bins(stats)
    gw, gv, gb = np.full(len(m.w), 1e-2), np.full(m.v.shape, 1e-2), 1e-2
    order = np.random.RandomState(seed)
    for _ in range(EPOCHS):
        deck = order.permutation(len(rows))
        for k in range(0, len(deck), 128):
            part = deck[k : k + 128]
            sizes = np.array([len(rows[i][2]) for i in part])
            doc = np.repeat(np.arange(len(part)), sizes)
            bucket = np.concatenate([rows[i][2] for i in part]).astype(np.int64)
            count = np.concatenate([rows[i][3] for i in part]).astype(np.float64)
            many = np.maximum(np.bincount(doc, count, minlength=len(part)), 1)
            # Words and bins as one list of (document, feature, value, squared value).
            feature = np.concatenate([bucket, bins[part].ravel()])
            where = np.concatenate([doc, np.repeat(np.arange(len(part)), STATS)])
            value = np.concatenate([count / many[doc], np.ones(len(part) * STATS)])
            square = np.concatenate([count / many[doc] ** 2, np.ones(len(part) * STATS)])
            v = m.v[feature]
            s = np.stack([np.bincount(where, v[:, f] * value, minlength=len(part)) for f in range(FACTORS)], axis=1)
            q = np.bincount(where, (v**2).sum(1) * square, minlength=len(part))
            y = m.bias + np.bincount(where, m.w[feature] * value, minlength=len(part)) + ((s**2).sum(1) - q) / 2
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[part]) / len(part)
            dw = np.bincount(feature, g[where] * value, minlength=len(m.w)) + 1e-6 * m.w
            dv = np.stack(
                [np.bincount(feature, g[where] * (s[where, f] * value - v[:, f] * square), minlength=len(m.w)) for f in range(FACTORS)], axis=1
            )
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            m.w -= 0.1 * dw / np.sqrt(gw)
            m.v -= 0.05 * dv / np.sqrt(gv)
            m.bias -= 0.1 * g.sum() / gb**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most `sample` labelled documents. labels: (doc_id, quality), nulls left out."""
    # The bound on the sample is the bound on what is broadcast and gathered.
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # Of rows with one id the smallest text is the labelled one, so as many texts are gathered as labels.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")

    @frugal

    def run(batches):
        for b in batches:
            for at, data, offsets in blocks(b):
                stats, bucket, starts = _runs(data, offsets)
                out = [np.unique(bucket[i:j], return_counts=True) for i, j in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(out)).cast(pa.int32()),
                        pa.array(list(stats), pa.list_(pa.float64())),
                        pa.array([o[0].astype(np.int32) for o in out], pa.list_(pa.int32())),
                        pa.array([o[1].astype(np.int32) for o in out], pa.list_(pa.int32())),
                    ],
                    ["label", "stats", "bucket", "n"],
                )

    got = texts.mapInArrow(run, "label int, stats array<double>, bucket array<int>, n array<int>").toArrow().to_batches()
    rows = []
    for b in got:
        for i in range(b.num_rows):
            rows.append((b.column(0)[i].as_py(), *(b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2, 3))))
    # Rows come in any order; the fit must not depend on it.
    rows.sort(key=lambda r: (r[0], r[1].tolist(), r[2].tobytes(), r[3].tobytes()))
    return fit(rows)


def score(docs: DataFrame, machine: Machine, *keep: str) -> DataFrame:
    """The columns `keep` and `score` of whole texts; null text is empty and has the score of no words."""
    names = list(keep)

    @frugal

    def run(batches):
        for b in batches:
            out = np.empty(b.num_rows)
            for at, data, offsets in blocks(b, len(names)):
                out[at : at + len(offsets) - 1] = machine.score(*_runs(data, offsets))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(out)], [*names, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*names).dtypes)
    return docs.select(*names, F.coalesce("text", F.lit("")).alias("__text")).mapInArrow(run, f"{schema}, score double")


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, whose whole text scores at least `threshold`."""
    text = docs.columns.index("text")

    @frugal

    def run(batches):
        for b in batches:
            good = np.empty(b.num_rows, bool)
            for at, data, offsets in blocks(b, text):
                good[at : at + len(offsets) - 1] = machine.score(*_runs(data, offsets)) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def fold(row_id: str = "doc_id"):
    """crc32 of the id as text, mod 4: rows with 2 are held out."""
    return F.crc32(F.col(row_id).cast("string").cast("binary")) % 4 == 2


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents`. Null and empty texts get the score of no words, null ids are not held out, repeated rows are scored
    each, an empty table gives no rows; without labels all scores lie near 0.5."""
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels").where(~fold()))
    return score(docs, machine, "doc_id").select(
        "doc_id", F.coalesce(fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op5_quality": op5_quality}
