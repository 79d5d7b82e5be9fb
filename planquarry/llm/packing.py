"""Packing documents into training sequences by order-preserving dynamic programming.

The documents of a partition, in their order, form one stream of token ids. Windows of at most `size`
ids are cut from it; a cut may stand at a document's end, at a sentence's end (penalty), or, inside very
long sentences, at fixed steps (larger penalty). The cheapest cuts minimise padding plus penalties:

    best[j] = penalty[j] + min over i with pos[j] - pos[i] <= size of (best[i] + size - (pos[j] - pos[i]))

As the padding is linear in pos[i], the minimum of best[i] + pos[i] over the sliding window is kept in a
monotone queue, so each candidate enters and leaves once. The stream is cut batch by batch: all windows
of a batch but the last are final, and the last one's ids go before the next batch.
The rest at a partition's end is cut into lengths that are powers of two.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import vocabulary, word_table
from .common import frugal, table

SIZE = 2048
SENTENCE_PENALTY = 4
INSIDE_PENALTY = 16
#: Ids that are gathered before windows are cut.
BLOCK = 400_000
#: Documents that are looked up in the word table at once.
SLICE = 512


def best_cuts(pos: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indices of the cheapest cuts among ascending candidate positions; the first and last are cuts.

    Neighbouring candidates must be at most `size` apart. Ties go to the earliest start of a window.
    """
    at, fine = pos.tolist(), penalty.tolist()
    cost, back = [0] * len(at), [0] * len(at)
    queue: deque = deque([(at[0], 0)])
    for j in range(1, len(at)):
        low = at[j] - size
        while at[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        back[j] = i
        cost[j] = value + size - at[j] + fine[j]
        value = cost[j] + at[j]
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(at) - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return [0, *reversed(cuts)]


class _Stream:
    """Ids of documents in order, cut into windows as they come."""

    def __init__(self, first_sequence: int, size: int, ends: np.ndarray):
        self.sequence, self.size, self.ends = first_sequence, size, ends
        self.new: list[np.ndarray] = []
        self.waiting = 0
        self.docs: list[tuple] = []  # (row id, ids before the part held, ids held, all ids)

    def add(self, ids: np.ndarray, docs: list[tuple]) -> None:
        self.new.append(ids)
        self.waiting += len(ids)
        self.docs += docs

    def cut(self, last: bool) -> list[tuple]:
        if not self.waiting:
            return []
        ids = np.concatenate(self.new)
        n = len(ids)
        held = np.fromiter((d[2] for d in self.docs), np.int64, len(self.docs))
        kind = np.full(n + 1, 127, np.uint8)
        inner = np.flatnonzero(self.ends[ids]) + 1
        kind[inner] = SENTENCE_PENALTY
        kind[np.cumsum(held)] = 0
        kind[0] = 0
        pos = np.flatnonzero(kind < 127)
        gaps = np.diff(pos)
        if (wide := np.flatnonzero(gaps > self.size // 16)).size:
            extra = np.concatenate([np.arange(pos[g] + self.size // 32, pos[g + 1], self.size // 32) for g in wide])
            kind[extra] = INSIDE_PENALTY
            pos = np.flatnonzero(kind < 127)
        cuts = pos[best_cuts(pos, kind[pos], self.size)].tolist()
        if last:
            # What is left at the end is cut into lengths that are powers of two, which need no padding.
            end = cuts.pop()
            begin = cuts[-1]
            rest = end - begin
            while rest:
                begin, rest = begin + (1 << rest.bit_length() - 1), rest - (1 << rest.bit_length() - 1)
                cuts.append(begin)
        elif len(cuts) > 2:
            cuts.pop()
        else:
            return []
        out, d, inside, raw = [], 0, 0, ids.astype("<u4")
        for begin, end in zip(cuts, cuts[1:]):
            at = begin
            while at < end:
                row, before, here, total = self.docs[d]
                take = min(end - at, here - inside)
                out.append((row, before + inside, take, zlib.crc32(raw[at : at + take].tobytes()), total, self.sequence, at - begin))
                at += take
                inside += take
                if inside == here:
                    d, inside = d + 1, 0
            self.sequence += 1
        rest = self.docs[d:]
        if rest and inside:
            row, before, here, total = rest[0]
            rest[0] = (row, before + inside, here - inside, total)
        self.new, self.docs = [ids[cuts[-1] :]], rest
        self.waiting = n - cuts[-1]
        return out


def sentence_ends(path: str) -> np.ndarray:
    """Per id: does its piece end a sentence? From the vocabulary's pieces; id 1 ends a document."""
    vocab = word_table(path, parts=True).tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    for piece, i in vocab.items():
        out[i] = piece.removesuffix("</w>")[-1:] in (".", "!", "?")
    return out


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 1, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per piece: where it comes from (start, length in the document's ids) and where it goes
    (sequence_id, offset). Null text is empty; an empty document is its end id; repeated rows are packed
    each; no documents give no rows. Ids are split at ASCII white space, which no word of the tokenizer
    crosses, and each distinct word is encoded once per worker.
    """

    @frugal

    def run(batches):
        from pyspark import TaskContext

        words = word_table(path, parts=True)
        stream = _Stream(TaskContext.get().partitionId() << 33, size, sentence_ends(path))
        names = [row_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def as_batch(rows, kind):
            columns = list(zip(*rows)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            rows, texts = b.column(0).to_pylist(), b.column(1).fill_null("")
            for at in range(0, len(rows), SLICE):
                found, counts = [], []
                for t in texts[at : at + SLICE].to_pylist():
                    raw = t.encode()
                    # The tokenizer lower-cases; special strings are told apart by case.
                    parts = (raw if b"<|" in raw else raw.lower()).split()
                    found += parts
                    counts.append(len(parts))
                ids, lengths = words.lookup(found)
                ends = np.append(0, np.cumsum(lengths))[np.cumsum(counts)]
                # The end id goes after each document's ids.
                ids = np.insert(ids, ends, end_id)
                totals = np.diff(ends, prepend=0) + 1
                stream.add(ids, [(row, 0, n, n) for row, n in zip(rows[at : at + SLICE], totals.tolist())])
                if stream.waiting >= BLOCK:
                    yield as_batch(stream.cut(False), kind)
        yield as_batch(stream.cut(True), kind)

    kind = dict(docs.dtypes)[row_id]
    return docs.select(row_id, text).mapInArrow(
        run, f"`{row_id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of 2048 ids. Null and empty texts are their end id, very long texts are cut, repeated rows are
    packed each, an empty table gives no rows; other columns are not looked at."""
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {"op2_packing": op2_packing}
