"""Removal of long repeated byte strings with a Burrows-Wheeler transform and threshold-bounded interval expansion.

Every window of `length` bytes is owned by an anchor, the leftmost smallest-hash gram of GRAM bytes in it, so equal
windows have equal anchors at equal places. Neighbouring windows with one anchor form a segment.

1. Anchors are counted over all texts; segments of anchors that occur once hold no repeat.
2. The others meet by anchor. Of equal segments all but the first repeat in full. What is left are the first
   copies of segments that share an anchor and differ somewhere.
3. Those segments' bytes meet by anchor. Each task builds their suffix array and Burrows-Wheeler transform, and
   expands a queue of intervals breadth first by backward extension: step l extends the intervals queued at l - 1
   by the bytes before them; right borders that are new are common prefixes of exactly l bytes. It stops at
   `length`; suffixes without a border between them share at least that much, and all but the first in
   (document, start) repeat.

Bloom filters of bounded size carry counts and chosen segments back to the texts: their false positives add work
and change nothing. Anchors of very many segments are split by a second anchor inside the windows. Where more than
CROWD different segments still share their anchors (a passage with as many neighbours), no group is gathered: each of
their windows is dealt by the hash of its bytes, and all but its first copy repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bloom_filter, in_filter
from .common import frugal, frugal_group, parts_for, table, written
from .textblocks import blocks, mix, prefix_hashes

LENGTH = 100
GRAM = 20
#: An anchor of at least this many segments is split by a second anchor.
FREQUENT = 200
#: Different segments of one anchor beyond which their windows are settled one by one.
CROWD = 2000
#: Segments that a task holds before it sends them on.
HELD = 300_000
#: Bytes that one suffix array covers, unless one anchor has more.
GROUP = 1 << 17
_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from running minima to both sides inside blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    full = np.full(-(-len(x) // width) * width, _MAX, x.dtype)
    full[: len(x)] = x
    grid = full.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


class Segments:
    """Segments of one block of texts: document, anchor place, first and last window start (places in the block)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, salt: int = 0):
        self.data, self.offsets, self.length = data, offsets, length
        self.sums, self.down = prefix_hashes(data)
        grams = len(data) - GRAM + 1
        empty = np.empty(0, np.int64)
        self.doc = self.anchor = self.lo = self.hi = empty
        if grams <= 0:
            return
        self.gram = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[:grams] + _U(salt))
        ordered = (self.gram & ~_U(0xFFFFFFFF)) | np.arange(grams, dtype=_U)
        at = (_window_min(ordered, length - GRAM + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        # Windows that stay in one document.
        sizes = np.diff(offsets)
        fit = np.zeros(len(data) + 1, np.int8)
        long = sizes >= length
        fit[offsets[:-1][long]] += 1
        fit[offsets[1:][long] - length + 1] -= 1
        inside = np.flatnonzero(np.cumsum(fit[: len(at)], dtype=np.int8) > 0)
        if not len(inside):
            return
        spot = at[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (spot[1:] != spot[:-1]) | (inside[1:] != inside[:-1] + 1)
        first = np.flatnonzero(new)
        self.lo, self.hi = inside[first], inside[np.append(first[1:], len(inside)) - 1]
        self.anchor = spot[first]
        self.doc = np.searchsorted(offsets, self.lo, "right") - 1

    def keys(self) -> np.ndarray:
        return mix(self.gram[self.anchor] ^ _U(0xA24BAED4963EE407)) if len(self.anchor) else np.empty(0, _U)

    def content(self) -> np.ndarray:
        """Hash of each segment's bytes and of where its anchor stands in them."""
        body = (self.sums[self.hi + self.length] - self.sums[self.lo]) * self.down[self.lo]
        return mix(mix(body) + ((self.anchor - self.lo) * 256 + (self.hi - self.lo)).astype(_U))


def _split(s: Segments, keys: np.ndarray, hot: np.ndarray):
    """Segments with those of `hot` anchors cut at second anchors: (doc, lo, hi, key, content hash)."""
    doc, lo, hi, content = s.doc, s.lo, s.hi, s.content()
    if not hot.any():
        return doc, lo, hi, keys, content
    at = np.flatnonzero(hot)
    size = hi[at] - lo[at] + s.length
    bounds = np.append(0, np.cumsum(size))
    body = s.data[np.arange(bounds[-1]) + np.repeat(lo[at] - bounds[:-1], size)]
    t = Segments(body, bounds, s.length, 0x6A09E667)
    own = at[t.doc]
    begin = lo[own] - bounds[t.doc]
    # Where the second anchor stands seen from the first is part of the key.
    apart = (t.anchor + begin - s.anchor[own]).astype(_U)
    second = mix(keys[own] + mix(t.keys() + apart))
    part = mix(t.content() + apart)
    cold = np.flatnonzero(~hot)
    join = lambda a, b: np.concatenate([a[cold], b])
    return join(doc, doc[own]), join(lo, t.lo + begin), join(hi, t.hi + begin), join(keys, second), join(content, part)


_FIELDS = [("key", _U), ("content", _U), ("doc_id", np.int64), ("mark", _U), ("lo", np.uint32), ("span", np.uint8)]


def _send(parts: int, columns: dict, rows=None) -> pa.RecordBatch:
    """Rows dealt to partitions by key, a binary per column and partition."""
    part = (columns["key"] >> _U(40)).astype(np.int64) * parts >> 24
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    out = [(p, i, j) for p, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]
    columns = {k: v[order] for k, v in columns.items()}
    arrays = [pa.array([p for p, _, _ in out], pa.int32())]
    arrays += [pa.array([v[i:j].tobytes() for _, i, j in out], pa.binary()) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, ["part", *columns])


def _received(table_: pa.Table, fields) -> dict:
    return {k: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table_.column(k)]) for k, t in fields}


def _first_of_equal(c: dict) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, content, document and place; is it the first of its key and content?)."""
    order = np.lexsort((c["lo"], c["mark"], c["doc_id"], c["content"], c["key"]))
    key, content = c["key"][order], c["content"][order]
    first = np.ones(len(order), bool)
    first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    return order, first


_SPANS = "doc_id long, mark long, lo long, span int, kind int"


def _spans(c: dict, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(c["doc_id"][rows], pa.int64()),
            pa.array(c["mark"][rows].view(np.int64)),
            pa.array(c["lo"][rows].astype(np.int64)),
            pa.array(c["span"][rows].astype(np.int32)),
            pa.array(np.full(len(rows), kind, np.int32)),
        ],
        ["doc_id", "mark", "lo", "span", "kind"],
    )


def _segments(batches, length, several, frequent):
    """Per block: (columns of the segments whose anchors occur more than once, the block)."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        marks = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
        for at, data, offsets in blocks(b):
            s = Segments(data, offsets, length)
            keys = s.keys()
            if len(keys):
                fine = np.flatnonzero(in_filter(*several, keys))
                s.doc, s.anchor, s.lo, s.hi, keys = s.doc[fine], s.anchor[fine], s.lo[fine], s.hi[fine], keys[fine]
            if not len(keys):
                continue
            doc, lo, hi, keys, content = _split(s, keys, in_filter(*frequent, keys))
            yield {
                "key": keys,
                "content": content,
                "doc_id": ids[at + doc].astype(np.int64),
                "mark": marks[at + doc],
                "lo": (lo - offsets[doc]).astype(np.uint32),
                "span": (hi - lo).astype(np.uint8),
            }, (data, lo)


def _windows(c: dict, rows: np.ndarray, data: np.ndarray, lo: np.ndarray, length: int) -> dict:
    """The windows of these segments as segments of their own, keyed by the hashes of their bytes."""
    many = c["span"][rows].astype(np.int64) + 1
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(lo[rows], many) + step
    sums, down = prefix_hashes(data)
    key = mix(mix((sums[at + length] - sums[at]) * down[at]) + _U(length))
    own = {k: np.repeat(c[k][rows], many) for k in ("doc_id", "mark", "lo")}
    return {"key": key, "content": key, **own, "lo": (own["lo"].astype(np.int64) + step).astype(np.uint32), "span": np.zeros(len(at), np.uint8)}


def _place(c: dict) -> np.ndarray:
    """One number for a segment's document and place."""
    return mix(c["doc_id"].view(_U) * _U(0x9E3779B97F4A7C15) + mix(c["mark"] + mix(c["lo"].astype(_U))))


def suffix_order(text: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """Suffix array of strings laid end to end (bytes + 1, each closed by a 0 at `ends`): suffixes stop at their 0;
    equal ones are ordered by place. Prefix doubling until `reach` bytes are compared."""
    n = len(text)
    place = np.arange(n)
    left = np.repeat(ends, np.diff(np.append(-1, ends))) - place  # how far the suffix at each place goes on
    rank = np.zeros(n, np.int64)
    for k in range(7):  # seven 9-bit symbols at first
        rank <<= 9
        rank[: n - k] |= np.where(left[: n - k] >= k, text[k:], 0)
    compared = 7
    while True:
        order = np.argsort(rank, kind="stable")
        ranked = rank[order]
        new = np.ones(n, bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if compared >= reach or new.all():
            return order
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(new)
        rank = dense * (n + 1)
        rank[: n - compared] += np.where(left[: n - compared] >= compared, dense[compared:], 0)
        compared *= 2


def long_prefixes(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, border[i]: do suffixes i-1 and i share fewer than `length` bytes?), by breadth-first interval
    expansion on the Burrows-Wheeler transform. Suffixes that stop before `length` have borders on both sides.

    The queue holds the intervals of strings of l bytes whose right border was new. Extending one by each byte that
    stands before its suffixes gives intervals of l + 1 bytes; a right border not yet known is a common prefix of
    exactly l bytes, and its interval is queued. A closing 0 differs from any other, so each is an interval of its own.
    """
    n = len(text)
    order = suffix_order(text, ends, length)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    # The transform: the byte before each suffix, and the suffix that begins with it.
    back = order - 1
    bwt = text[back].astype(np.int16)
    bwt[back < 0] = 0
    longer = place[back]
    shorter = place[np.minimum(order + 1, n - 1)]
    first = text[order].astype(np.int16)
    owner = np.empty(n, np.int32)
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    # Strings of one byte: the children of the empty string.
    begin = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (first[1:] == 0)))
    end = np.append(begin[1:], n)
    border[end] = True
    for _ in range(1, length):
        if not len(begin):
            break
        sizes = end - begin
        bounds = np.cumsum(sizes)
        rows = np.arange(bounds[-1]) + np.repeat(begin - bounds + sizes, sizes)
        owner[rows] = np.repeat(np.arange(len(begin), dtype=np.int32), sizes)
        grown = longer[rows[bwt[rows] > 0]]
        if not len(grown):
            break
        grown.sort()
        from_, byte = owner[shorter[grown]], first[grown]
        edge = np.flatnonzero((from_[1:] != from_[:-1]) | (byte[1:] != byte[:-1]))
        begin, end = grown[np.append(0, edge + 1)].astype(np.int64), grown[np.append(edge, len(grown) - 1)].astype(np.int64) + 1
        fresh = ~border[end]
        begin, end = begin[fresh], end[fresh]
        border[end] = True
    return order, border[:n]


def _repeats_in(c: dict, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window offset) of every window in these segments that also starts earlier in one of them."""
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    raw = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + 1
    own = np.repeat(np.arange(len(bodies)), sizes)
    text[np.arange(len(raw)) + own] = raw
    order, border = long_prefixes(text, ends, length)
    group = np.cumsum(border)
    many = np.bincount(group)[group] > 1
    order, group = order[many], group[many]
    seg = np.searchsorted(ends, order, "left")
    inside = order - (ends[seg] - sizes[seg])
    start = c["lo"][seg].astype(np.int64) + inside
    rows = np.lexsort((start, c["mark"][seg], c["doc_id"][seg], group))
    g = group[rows]
    again = np.zeros(len(rows), bool)
    again[1:] = g[1:] == g[:-1]
    # One place that came twice (a repeated row) is no repeat of itself.
    again[1:] &= (start[rows][1:] != start[rows][:-1]) | (c["doc_id"][seg][rows][1:] != c["doc_id"][seg][rows][:-1]) | (
        c["mark"][seg][rows][1:] != c["mark"][seg][rows][:-1]
    )
    return seg[rows][again], inside[rows][again]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, mark, lo, span): windows lo to lo + span of a document (mark: its text's 64-bit hash) that start
    earlier somewhere. docs: (doc_id, text, mark)."""
    if not GRAM < length < GRAM + 256:
        raise ValueError(f"length must be over {GRAM} and under {GRAM + 256}")
    spark, crowd = docs.sparkSession, CROWD
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = min(parts_for(spark, total, 20 << 20), 1 << 20)

    @frugal

    def anchors(batches):
        held, size = [], 0
        for b in batches:
            for _, data, offsets in blocks(b):
                held.append(Segments(data, offsets, length).keys())
                size += len(held[-1])
                if size > HELD:
                    keys, n = np.unique(np.concatenate(held), return_counts=True)
                    yield _send(parts, {"key": keys, "n": np.minimum(n, 60000).astype(np.uint16)})
                    held, size = [], 0
        if size:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            yield _send(parts, {"key": keys, "n": np.minimum(n, 60000).astype(np.uint16)})

    @frugal_group

    def count(key, rows):
        c = _received(rows, [("key", _U), ("n", np.uint16)])
        order = np.argsort(c["key"], kind="stable")
        keys = c["key"][order]
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.add.reduceat(c["n"][order].astype(np.int64), cut)
        many = n > 1
        return pa.Table.from_arrays([pa.array(keys[cut][many].view(np.int64)), pa.array(n[many])], ["key", "n"])

    counted = written(docs.mapInArrow(anchors, "part int, key binary, n binary").groupBy("part").applyInArrow(count, "key long, n long"), "repeats")
    often = counted.where(F.col("n") >= FREQUENT)
    filters = spark.sparkContext.broadcast((bloom_filter(counted, "key", counted.count()), bloom_filter(often, "key", often.count())))

    def dealt_from(found):
        """Segments by key, of equal ones in a task the first only; the others repeat and are sent as such (part below 0). Batches that
        are ready pass through."""
        held, size = [], 0

        def flush():
            c = {k: np.concatenate([h[k] for h in held]) for k, _ in _FIELDS}
            order, first = _first_of_equal(c)
            firsts, others = order[first], order[~first]
            # A place that came twice (a repeated row) is no repeat of itself.
            lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))][~first]
            same = (c["doc_id"][others] == c["doc_id"][lead]) & (c["mark"][others] == c["mark"][lead]) & (c["lo"][others] == c["lo"][lead])
            others = others[~same]
            if len(others):
                own = {k: c[k][others] for k, _ in _FIELDS}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - int(own["key"][0] % _U(parts))], pa.int32()), *(pa.array([own[k].tobytes()], pa.binary()) for k, _ in _FIELDS)],
                    ["part", *(k for k, _ in _FIELDS)],
                )
            yield _send(parts, {k: c[k][firsts] for k, _ in _FIELDS})

        for c in found:
            if isinstance(c, pa.RecordBatch):
                yield c
                continue
            held.append(c)
            size += len(c["key"])
            if size > HELD:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    @frugal

    def dealt(batches):
        yield from dealt_from(c for c, _ in _segments(batches, length, *filters.value))

    @frugal_group

    def settle(key, rows):
        c = _received(rows, _FIELDS)
        if key[0].as_py() < 0:
            return pa.Table.from_batches([_spans(c, np.arange(len(c["key"])), 0)])
        order, first = _first_of_equal(c)
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        same = (c["doc_id"][order] == c["doc_id"][lead]) & (c["mark"][order] == c["mark"][lead]) & (c["lo"][order] == c["lo"][lead])
        keys = c["key"][order[first]]
        begins = np.append(True, keys[1:] != keys[:-1])
        which = np.cumsum(begins) - 1
        many = np.bincount(which)[which] if len(which) else which
        few, crowded = order[first][(many > 1) & (many <= crowd)], order[first][many > crowd]
        return pa.Table.from_batches([_spans(c, order[~first & ~same], 0), _spans(c, few, 1), _spans(c, crowded, 2)])

    fields = ", ".join(f"{k} binary" for k, _ in _FIELDS)
    settled = written(docs.mapInArrow(dealt, f"part int, {fields}").groupBy("part").applyInArrow(settle, _SPANS), "repeats")

    @frugal

    def places(batches):
        for b in batches:
            c = {"doc_id": b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), "mark": b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(_U), "lo": b.column(2).to_numpy()}
            yield pa.RecordBatch.from_arrays([pa.array(_place(c).view(np.int64))], ["place"])

    counts = {r.kind: r["count"] for r in settled.groupBy("kind").count().collect()}
    any_dense = bool(counts.get(2))
    of_kind = lambda kind: settled.where(F.col("kind") == kind).select("doc_id", "mark", "lo").mapInArrow(places, "place long")
    chosen, dense = (spark.sparkContext.broadcast(bloom_filter(of_kind(k), "place", counts.get(k, 0))) for k in (1, 2))

    whole = ["part", "body", *(k for k, _ in _FIELDS)]

    def body(c, data, lo, fine):
        part = (c["key"][fine] >> _U(40)).astype(np.int64) * parts >> 24
        fine = fine[np.argsort(part, kind="stable")]
        part = np.sort(part)
        cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        texts = [data[a : a + n].tobytes() for a, n in zip(lo[fine].tolist(), (c["span"][fine].astype(np.int64) + length).tolist())]
        rows = [(int(part[i]), b"".join(texts[i:j]), *(c[k][fine[i:j]].tobytes() for k, _ in _FIELDS)) for i, j in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array(list(x), pa.binary()) for x in list(zip(*rows))[1:])], whole)

    @frugal

    def left(batches):
        """Bodies of chosen segments (part from 0) and windows of crowded ones (part from `parts`, or below 0), in one pass over the texts."""

        def found():
            for c, (data, lo) in _segments(batches, length, *filters.value):
                place = _place(c)
                rows = np.flatnonzero(in_filter(*chosen.value, place))
                if len(rows):
                    yield body(c, data, lo, rows)
                rows = np.flatnonzero(in_filter(*dense.value, place)) if any_dense else rows[:0]
                # A block may hold many such windows: they are held in parts.
                for at in range(0, len(rows), 2000):
                    yield _windows(c, rows[at : at + 2000], data, lo, length)

        for b in dealt_from(found()):
            if b.num_columns < len(whole):
                part = b.column(0).to_numpy()
                b = pa.RecordBatch.from_arrays([pa.array(np.where(part < 0, part, part + parts).astype(np.int32)), pa.nulls(len(part), pa.binary()), *b.columns[1:]], whole)
            yield b

    @frugal_group

    def expand(key, rows):
        if not 0 <= key[0].as_py() < parts:
            return settle(key, rows)
        c = _received(rows, _FIELDS)
        sizes = c["span"].astype(np.int64) + length
        joined = b"".join(rows.column("body").to_pylist())
        at = np.append(0, np.cumsum(sizes))
        # Segments of one anchor stay together; a task's segments are expanded in groups of about GROUP bytes.
        order = np.argsort(c["key"], kind="stable")
        keys = c["key"][order]
        begins = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
        filled = np.append(0, np.cumsum(sizes[order]))
        out, i = [], 0
        while i < len(begins) - 1:
            j = max(i + 1, int(np.searchsorted(filled[begins], filled[begins[i]] + GROUP, "right")) - 1)
            own = order[begins[i] : begins[j]]
            i = j
            if len(own) < 2:
                continue
            seg, inside = _repeats_in({k: v[own] for k, v in c.items()}, [joined[at[k] : at[k + 1]] for k in own], length)
            if len(seg):
                # Neighbouring windows of a segment are one span.
                o = np.lexsort((inside, seg))
                seg, inside = seg[o], inside[o]
                new = np.append(True, (seg[1:] != seg[:-1]) | (inside[1:] > inside[:-1] + 1))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(seg)) - 1
                rows_ = own[seg[first]]
                out.append(_spans({**{k: v[rows_] for k, v in c.items()}, "lo": c["lo"][rows_] + inside[first], "span": inside[last] - inside[first]}, np.arange(len(first)), 0))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_spans(c, np.arange(0), 0)])

    sent = docs.mapInArrow(left, f"part int, body binary, {fields}")
    expanded = written(sent.groupBy("part").applyInArrow(expand, _SPANS), "repeats")
    out = settled.where("kind = 0").unionByName(expanded.where("kind = 0"))
    for held in (filters, chosen, dense):
        held.destroy()
    return out.select("doc_id", "mark", "lo", "span")


def with_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): null texts empty, null ids smallest; mark tells apart rows of one id with unequal texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long").alias("doc_id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row, and kept_text (bytes that are no whole character
    any more are dropped) if asked for, and `extra` columns of docs.

    Rows of one id with equal texts are one document seen twice, and get one result each; with unequal texts they
    are documents in the order of their texts' hashes.
    """
    marked = with_marks(docs)
    spans = repeated_spans(marked, length)
    per_doc = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "span")).alias("spans"))
    names = ["doc_id", *extra]
    held = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(names)], F.coalesce("text", F.lit("")).alias("text"))
    held = held.withColumn("doc_id", F.coalesce(F.col("__0"), F.lit(-(2**63))).cast("long")).withColumn("mark", F.xxhash64("text"))
    joined = held.join(per_doc, ["doc_id", "mark"], "left").select(*[f"__{i}" for i in range(len(names))], "text", "spans")

    @frugal

    def run(batches):
        k = len(names)
        for b in batches:
            out = []
            for text, spans in zip(b.column(k), b.column(k + 1)):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                kept, removed, runs = raw, 0, 0
                if spans.is_valid:
                    lo, span = (spans.values.field(f).to_numpy() for f in ("lo", "span"))
                    step = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(step, lo, 1)
                    np.add.at(step, np.minimum(lo + span + length, len(raw)), -1)
                    gone = np.cumsum(step)[:-1] > 0
                    removed = int(gone.sum())
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = raw[~gone]
                body = kept.tobytes()
                out.append((len(raw), removed, runs, hashlib.sha256(body).hexdigest(), body.decode("utf-8", "ignore") if keep_text else None))
            columns = list(zip(*out)) or [()] * 5
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())]
            fields = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(columns[4], pa.string()))
                fields.append("kept_text")
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), *arrays], [*names, *fields])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    tail = ", kept_text string" if keep_text else ""
    return joined.mapInArrow(run, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{tail}")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` without repeated passages; see `cut_repeats` for repeated rows. Null texts are empty, null ids count as the
    smallest id, texts of any length are taken whole, an empty table gives no rows."""
    return cut_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op10_repeats": op10_repeats}

_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM h WHERE length(h) >= 200)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(w) ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i - prev <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM d)),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
z AS (SELECT doc_id, a, b FROM u UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM h),
k AS (SELECT z.doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY z.doc_id ORDER BY a, b) AS prev FROM z)
SELECT k.doc_id AS doc_id, CAST(max(length(h) // 2) AS BIGINT) AS n_bytes, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a, b))) AS kept_sha256 FROM k JOIN h ON h.doc_id = k.doc_id GROUP BY k.doc_id
"""
ORACLE_SQL = {"op10_repeats": _SQL}
