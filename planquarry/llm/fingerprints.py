"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases by deterministic coin tossing: runs of one symbol are single
symbols, then each symbol gets the place and value of the lowest bit in which it differs from its left
neighbour, twice more, which leaves small labels of which neighbours differ; strict local maxima among
these, and nothing else, begin phrases. Phrases are named by hashes of their symbols, and the names are
parsed again, level by level. A cut depends on a few symbols around it only, so equal substrings get equal
interior phrases wherever they stand. The fingerprint holds, for SLOTS hash functions in one (the name's
low bits choose the slot), the smallest name among the phrases of the highest level in LEVELS that has one for the
slot: long texts fill nearly all slots from level 3, short ones the rest from the shorter phrases below.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table

LEVELS = (1, 2, 3)
SLOTS = 64
#: Bytes of text that are parsed together.
BLOCK = 1 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): fixed constants."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd 64-bit step."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.empty(max(n, 1 << 16), _U)
        p[0] = 1
        p[1:] = _STEP
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def _toss(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Coin tossing: 2 * (lowest differing bit) + its value, against the left neighbour; neighbours that differ still differ after."""
    d = np.empty_like(x)
    d[1:] = x[1:] ^ x[:-1]
    d[begins] = _U(1)  # a document's first symbol has no left neighbour
    low = d & (~d + _U(1))
    place = np.frexp(low.astype(np.float64))[1] - 1
    value = (x & low) != 0
    return (2 * place + value).astype(_U)


def parse(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of each document and their offsets. symbols: uint64, documents end to end."""
    n = len(symbols)
    if not n:
        return symbols, offsets
    full = offsets[:-1] < offsets[1:]
    first = np.zeros(n, bool)
    first[offsets[:-1][full]] = True
    # Runs of one symbol become one symbol that holds the run's length.
    keep = first.copy()
    keep[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(keep)
    runs = np.diff(np.append(at, n)).astype(_U)
    x = symbols[at]
    long = runs > _U(1)
    x[long] = mix(x[long] + runs[long] * _STEP)
    begins = np.flatnonzero(first[at])
    m = len(x)
    label = _toss(_toss(_toss(x, begins), begins), begins)
    # A local maximum is strict on both sides; a document's last symbol begins no phrase unless it is the only one.
    start = np.zeros(m, bool)
    if m > 2:
        start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    start[np.append(begins[1:], m) - 1] = False
    start[begins] = True
    cut = np.flatnonzero(start)
    # A phrase's name hashes its symbols with their places in it, and its length.
    length = np.diff(np.append(cut, m))
    inside = np.arange(m) - np.repeat(cut, length)
    names = mix(np.add.reduceat(mix(x + _STEP) * powers(int(length.max()) + 1)[inside], cut) + length.astype(_U))
    docs = np.zeros(len(offsets), np.int64)
    docs[1:] = np.cumsum(np.bincount(np.searchsorted(offsets, at[cut], "right") - 1, minlength=len(offsets) - 1))
    return names, docs


def _signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint32 array (documents, SLOTS); documents without phrases keep the largest value everywhere."""
    n = len(offsets) - 1
    out = np.full(n * SLOTS, 0xFFFFFFFF, np.uint32)
    symbols = data.astype(_U) + _U(1)
    for level in range(1, max(LEVELS) + 1):
        symbols, offsets = parse(symbols, offsets)
        if level in LEVELS and len(symbols):
            h = mix(symbols ^ _U(level))
            slot = (h & _U(SLOTS - 1)).astype(np.int64) + np.repeat(np.arange(n) * SLOTS, np.diff(offsets))
            value = (h >> _U(32)).astype(np.uint32)
            order = np.argsort(slot, kind="stable")
            slot, value = slot[order], value[order]
            cut = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            # A higher level replaces what lower ones left in a slot.
            out[slot[cut]] = np.minimum.reduceat(value, cut)
    return out.reshape(n, SLOTS)


def signatures(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of UTF-8 texts as rows of SLOTS numbers, parsed in blocks of whole documents."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        offsets = np.zeros(end - at + 1, np.int64)
        offsets[1:] = np.cumsum([len(t) for t in texts[at:end]])
        out.append(_signatures(np.frombuffer(b"".join(texts[at:end]), np.uint8), offsets))
        at = end
    return np.concatenate(out) if out else np.empty((0, SLOTS), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either has filled; 1 where neither has any."""
    filled = (a != 0xFFFFFFFF) | (b != 0xFFFFFFFF)
    total = filled.sum(1)
    return np.where(total, ((a == b) & filled).sum(1) / np.maximum(total, 1), 1.0)


def in_hex(sig: np.ndarray) -> list[str]:
    raw = sig.astype(">u4").tobytes()
    return [raw[i : i + 4 * SLOTS].hex() for i in range(0, len(raw), 4 * SLOTS)]


def fingerprint(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, fingerprint string) of whole texts. Null text is empty; the empty text's fingerprint is all ones."""

    @frugal

    def run(batches):
        for b in batches:
            texts = [t.encode() for t in b.column(1).fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(in_hex(signatures(texts)), pa.string())], [row_id, "fingerprint"])

    kind = dict(docs.dtypes)[row_id]
    return docs.select(row_id, text).mapInArrow(run, f"`{row_id}` {kind}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(block, halo, doc_id, text): rows in descending doc_id inside blocks, each block followed by a halo row that
    copies the first row of the next block (after the last block: the first of all). One exchange of the texts.

    Blocks are ranges of doc_id, as many as the session has shuffle partitions, between approximate quantiles of
    all ids; rows with equal ids share a block. A null id counts as the smallest.
    """
    spark = docs.sparkSession
    least = -(2**63)
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(least)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / blocks for k in range(1, blocks)]
    bounds = sorted({int(b) for b in docs.stat.approxQuantile("key", cuts, 0.1 / blocks)}) if cuts else []
    block = F.lit(0)
    if bounds:
        block = F.aggregate(F.lit(bounds), F.lit(0), lambda n, b: n + (b <= F.col("key")).cast("int"))
    placed = docs.withColumn("block", block.cast("int"))
    firsts = sorted((r.block, r.key) for r in placed.groupBy("block").agg(F.max("key").alias("key")).collect())
    # The halo of a block: the first row of the block below it; of the lowest block: the first row of all.
    halos = [(b, firsts[i - 1][1]) for i, (b, _) in enumerate(firsts)]
    halo = spark.createDataFrame(halos, "halo_block int, key long")
    copies = (
        docs.join(F.broadcast(halo), "key")
        .groupBy("halo_block")
        .agg(F.max(F.struct("key", "text", "doc_id")).alias("f"))
        .select(F.col("halo_block").alias("block"), F.lit(1).alias("halo"), "f.key", "f.doc_id", "f.text")
    )
    rows = placed.select("block", F.lit(0).alias("halo"), "key", "doc_id", "text").unionByName(copies)
    return rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "halo", F.desc("key"), F.desc("text"))


def edited_pairs(docs: DataFrame, slice_rows: int = 512) -> DataFrame:
    """Fingerprints of every text, of its edited form and their likeness; see op8's contract for the edit.

    Ties of doc_id are ordered by text, descending; repeated rows follow each other. A single document is its own next.
    """

    def rows_of(batches):
        for b in batches:
            for at in range(0, b.num_rows, slice_rows):
                part = b.slice(at, slice_rows)
                yield list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist()))

    def emit(rows, prints):
        """Output for all rows but the last; prints are their fingerprints."""
        here = [i for i in range(len(rows) - 1) if not rows[i][1]]
        texts = [rows[i][3] for i in here]
        edited = [(t[: len(t) - len(t) // 2] + rows[i + 1][3][: len(t) // 2]).encode("utf-8") for i, t in zip(here, texts)]
        marks = signatures(edited)
        own, following = prints[here], prints[[i + 1 for i in here]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in here], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array(in_hex(own), pa.string()),
                pa.array(in_hex(marks), pa.string()),
                pa.array(likeness(own, marks), pa.float64()),
                pa.array(likeness(own, following), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    @frugal

    def run(batches):
        rows: list = []
        prints = np.empty((0, SLOTS), np.uint32)
        for more in rows_of(batches):
            rows += more
            prints = np.concatenate([prints, signatures([r[3].encode("utf-8") for r in more])])
            yield emit(rows, prints)
            rows, prints = rows[-1:], prints[-1:]

    return with_next(docs).select("block", "halo", "key", "doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all `documents` and of their edited texts; see `edited_pairs` and `with_next` for ties and null ids. Null
    texts are empty, texts are parsed whole, an empty table gives no rows."""
    return edited_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
