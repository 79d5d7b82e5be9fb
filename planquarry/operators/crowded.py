"""One drawing with more boxes than a matrix of all pairs holds: overlapping pairs by sorted ranges, choices in turn.

Boxes of equal corners and class are one type with a queue of members. A pair of boxes whose overlap is t overlaps by t
at least along each axis, too, which bounds the ratio of their sides and the distance of their centres. All choices are
those of the matrix: overlaps are computed the same way, pairs are only found in another order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

TESTS = 1 << 17
"""Pairs tested at once."""
HELD = 1 << 20
"""Pairs kept at once; beyond it a level is narrowed or fewer boxes take their turn together."""
ROWS = 48
LEVELS = [0.9, 0.8, 0.7, 0.55]


def sound(boxes: np.ndarray) -> np.ndarray:
    """Boxes that can overlap anything."""
    return np.isfinite(boxes).all(axis=1) & (boxes[:, 0] < boxes[:, 2]) & (boxes[:, 1] < boxes[:, 3])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row number `counts` times, and the number of each repetition."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Index:
    """Boxes by group, class of width, row of their centre's height and place of their centre from left to right."""

    STEP = np.log(1.5)

    def __init__(self, boxes: np.ndarray, groups: np.ndarray, ids: np.ndarray):
        w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
        x, y = (boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2
        n = len(boxes)
        self.highest, self.slack = h.max(initial=0.0), 4e-15 * np.abs(boxes).max(initial=0.0)
        self.classes, kind = np.unique(np.floor(np.log(w) / self.STEP).astype(np.int64), return_inverse=True)
        self.rows = min(ROWS, max(1, n // 64))
        self.edges = np.sort(y)[np.arange(1, self.rows) * n // self.rows]
        self.x, self.n = np.sort(x), n + 1
        key = ((groups * len(self.classes) + kind) * self.rows + np.searchsorted(self.edges, y, "right")) * self.n + np.searchsorted(self.x, x)
        order = np.argsort(key, kind="stable")
        self.key, self.ids = key[order], ids[order]
        self.corners = [np.ascontiguousarray(boxes[order, k]) for k in range(4)]
        self.area = (self.corners[2] - self.corners[0]) * (self.corners[3] - self.corners[1])

    def pairs(self, boxes: np.ndarray, groups: np.ndarray, least: float, strict: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of boxes, id, overlap) of pairs in the same group that overlap by `least` (more than it if strict)."""
        if not self.n > 1 or not len(boxes):
            return
        t = least * (1 - 1e-9)
        w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
        x, y = (boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2
        area, near = w * h, (1 - t) / (2 * (1 + t)) * (1 + 1e-9)
        slack = self.slack + 4e-15 * np.abs(boxes).max()
        reach = (h + np.minimum(h / t, self.highest)) * near + slack
        first, last = np.searchsorted(self.edges, y - reach, "right"), np.searchsorted(self.edges, y + reach, "right")
        low = np.searchsorted(self.classes, np.floor(np.log(w * t) / self.STEP - 1e-9))
        high = np.searchsorted(self.classes, np.floor(np.log(w / t) / self.STEP + 1e-9), "right")
        a, k = _spread(high - low)
        kind = low[a] + k
        reach = (w[a] + np.minimum(w[a] / t, np.exp((self.classes[kind] + 1) * self.STEP) * (1 + 1e-9))) * near + slack
        left, right = np.searchsorted(self.x, x[a] - reach), np.searchsorted(self.x, x[a] + reach, "right")
        b, k = _spread((last - first + 1)[a])
        base = ((groups[a[b]] * len(self.classes) + kind[b]) * self.rows + first[a[b]] + k) * self.n
        begin = np.searchsorted(self.key, base + left[b])
        count = np.searchsorted(self.key, base + right[b]) - begin
        some = count > 0
        owner, begin, count = a[b[some]], begin[some], count[some]
        ends = np.cumsum(count)
        at = 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TESTS, "right")))
            r, k = _spread(count[at:to])
            u, v = owner[at:to][r], begin[at:to][r] + k
            at = to
            c = self.corners
            both = np.minimum(boxes[u, 2], c[2][v]) - np.maximum(boxes[u, 0], c[0][v])
            both = np.maximum(both, 0) * np.maximum(np.minimum(boxes[u, 3], c[3][v]) - np.maximum(boxes[u, 1], c[1][v]), 0)
            union = area[u] + self.area[v] - both
            iou = np.divide(both, union, out=np.zeros(len(u)), where=union > 0)
            fine = iou > least if strict else iou >= least
            if fine.any():
                yield u[fine], self.ids[v[fine]], iou[fine]


class _Types:
    """Boxes of equal corners and class, and which of their members (numbers, in order) is next."""

    def __init__(self, boxes: np.ndarray, cats: np.ndarray, usable: np.ndarray):
        rows = np.flatnonzero(usable)
        order = rows[np.lexsort((cats[rows], *boxes[rows].T))]
        new = np.ones(len(order), bool)
        new[1:] = (boxes[order[1:]] != boxes[order[:-1]]).any(axis=1) | (cats[order[1:]] != cats[order[:-1]])
        starts = np.flatnonzero(new)
        self.boxes, self.cats = boxes[order[starts]], cats[order[starts]]
        self.of = np.full(len(boxes), -1)
        self.of[order] = np.cumsum(new) - 1
        self.members, self.next, self.end = order.tolist(), starts.tolist(), np.append(starts[1:], len(order)).tolist()
        self.left, self.free = np.ones(len(starts), bool), bytearray(b"\1" * len(starts))
        self.used = np.zeros(len(boxes), bool)

    def head(self, t: int) -> int:
        return self.members[self.next[t]]

    def take(self, t: int) -> int:
        """The next member; `left` and `free` (for single ones) say whether more are there."""
        member = self.members[self.next[t]]
        self.next[t] += 1
        if self.next[t] == self.end[t]:
            self.left[t] = self.free[t] = False
        self.used[member] = True
        return member


def _side(first: _Types, second: _Types, same: bool | None):
    """Index of the second side's free types and what a pair must satisfy; same: None means any classes."""
    free = np.flatnonzero(second.left)
    grouped = same is True
    index = _Index(second.boxes[free], second.cats[free] if grouped else np.zeros(len(free), np.int64), free)

    def pairs(types: np.ndarray, least: float, strict: bool):
        groups = first.cats[types] if grouped else np.zeros(len(types), np.int64)
        for u, v, iou in index.pairs(first.boxes[types], groups, least, strict):
            if same is False:
                other = first.cats[types[u]] != second.cats[v]
                u, v, iou = u[other], v[other], iou[other]
            yield types[u], v, iou

    return pairs


def _best_first(first: _Types, second: _Types, least: float, strict: bool, same: bool | None, score, out: list) -> None:
    """Pairs by falling score, then by first and second member; `score` is a rising function of the overlap."""
    for level in [*[x for x in LEVELS if x > least], least]:
        done = False
        while not done:
            # Pairs below `cut` are left for another pass when more than HELD are found.
            pairs, cut, held, size, done = _side(first, second, same), level, [], 0, True
            free = np.flatnonzero(first.left)
            for at in range(0, len(free), 2048):
                for u, v, iou in pairs(free[at : at + 2048], cut, strict and cut == least):
                    s = score(iou)
                    if not done:
                        fine = s >= bound
                        u, v, s = u[fine], v[fine], s[fine]
                    held.append((u, v, s))
                    size += len(u)
                    if size > HELD:
                        u, v, s = (np.concatenate(x) for x in zip(*held))
                        middle = np.sort(s)[len(s) // 2]
                        if middle == s.min():
                            middle = s[s > middle].min(initial=np.inf)
                        if middle < np.inf:
                            done, bound = False, middle
                            fine = s >= bound
                            u, v, s = u[fine], v[fine], s[fine]
                        held, size = [(u, v, s)], len(u)
            if held:
                _settle(first, second, *(np.concatenate(x) for x in zip(*held)), out)


def _settle(first: _Types, second: _Types, u: np.ndarray, v: np.ndarray, s: np.ndarray, out: list) -> None:
    order = np.argsort(-s, kind="stable")
    u, v, s = u[order], v[order], s[order]
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]) + 1, len(s))
    at, k = 0, 0
    while at < len(s):
        # Runs of equal scores, about 20,000 pairs at once; what has gone by then is left out.
        k = max(k + 1, int(np.searchsorted(ends, at + 20000)))
        to = int(ends[k - 1])
        live = np.flatnonzero(first.left[u[at:to]] & second.left[v[at:to]]) + at
        at = to
        a, b, c = u[live].tolist(), v[live].tolist(), s[live].tolist()
        i = 0
        while i < len(a):
            j = i + 1
            while j < len(a) and c[j] == c[i]:
                j += 1
            run = [(x, y) for x, y in zip(a[i:j], b[i:j]) if first.free[x] and second.free[y]] if j - i > 1 else [(a[i], b[i])]
            i = j
            if len(run) == 1:
                x, y = run[0]
                while first.free[x] and second.free[y]:
                    out.append((first.take(x), second.take(y)))
            elif run:
                _settle_equal(first, second, run, out)


def _settle_equal(first: _Types, second: _Types, run: list, out: list) -> None:
    """Pairs of equal scores: by first member, then by second."""
    partners: dict = {}
    for x, y in run:
        partners.setdefault(x, []).append(y)
    queue = [(first.head(x), x) for x in partners]
    heapq.heapify(queue)
    while queue:
        x = queue[0][1]
        free = [y for y in partners[x] if second.free[y]]
        if not free:
            heapq.heappop(queue)
            continue
        partners[x] = free
        out.append((first.take(x), second.take(min(free, key=second.head))))
        if first.free[x]:
            heapq.heapreplace(queue, (first.head(x), x))
        else:
            heapq.heappop(queue)


def _in_turn(first: _Types, second: _Types, least: float, strict: bool, same: bool | None, flat: bool, out: list) -> None:
    """Each member of the first side in turn takes its best free partner (if flat: any that overlaps enough); of equal ones the first."""
    turns = np.flatnonzero((first.of >= 0) & ~first.used)
    levels = [least] if flat else [*[x for x in LEVELS if x > least], least]
    at, size, built, pairs = 0, 512, -1, None
    # Per type its partners, best first, where its free ones begin, and the level to which they are whole.
    lists, begun, full, kept = {}, {}, {}, 0
    while at < len(turns):
        free = int(second.left.sum())
        if not free:
            return
        if pairs is None or free < 0.9 * built:
            pairs, built = _side(first, second, same), free
        types, n = np.unique(first.of[turns[at : at + size]], return_counts=True)
        if kept > HELD:
            lists, begun, full, kept = {}, {}, {}, 0
        short = lambda t, m: t not in full or full[t] > least and len(lists[t][0]) - begun[t] < m  # noqa: B023, E731
        asked = np.array([short(t, m) for t, m in zip(types.tolist(), n.tolist())], bool)
        types, n, crowded = types[asked], n[asked], False
        for level in levels if len(types) else []:
            found, held = [], 0
            for u, v, iou in pairs(types, level, strict and level == least):
                fine = second.left[v]
                if fine.any():
                    found.append((u[fine], v[fine], iou[fine]))
                    held += int(fine.sum())
                if held > HELD and size > 1:
                    crowded = True
                    break
            if crowded:
                break
            for t in types.tolist():
                lists[t], begun[t], full[t] = ((), ()), 0, level
            if found:
                u, v, iou = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(-iou, kind="stable") if not flat else np.arange(len(u))
                order = order[np.argsort(u[order], kind="stable")]
                u, v, iou = u[order], v[order], iou[order]
                starts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
                ends = np.append(starts[1:], len(u))
                for t, a, b in zip(u[starts].tolist(), starts.tolist(), ends.tolist()):
                    lists[t] = (v[a:b].tolist(), iou[a:b].tolist())
                kept += len(u)
            enough = np.array([len(lists[t][0]) >= 4 + m for t, m in zip(types.tolist(), n.tolist())], bool)
            types, n = types[~enough], n[~enough]
            if not len(types):
                break
        if crowded:
            size = max(1, size // 2)
            continue
        ahead = turns[at : at + size]
        for p, t in zip(ahead.tolist(), first.of[ahead].tolist()):
            (v, iou), k = lists[t], begun[t]
            while k < len(v) and not second.free[v[k]]:
                k += 1
            if k == len(v) and full[t] > least:
                found = [(y, z) for _, y, z in pairs(np.array([t]), least, strict)]
                full[t], k, v, iou = least, 0, (), ()
                if found:
                    y, z = (np.concatenate(x) for x in zip(*found))
                    y, z = y[second.left[y]], z[second.left[y]]
                    order = np.argsort(-z, kind="stable")
                    v, iou = y[order].tolist(), z[order].tolist()
                lists[t] = (v, iou)
                kept += len(v)
            begun[t] = k
            if k == len(v):
                continue
            best, j = v[k], k + 1
            while j < len(v) and (flat or iou[j] == iou[k]):
                if second.free[v[j]] and second.head(v[j]) < second.head(best):
                    best = v[j]
                j += 1
            first.take(t)
            out.append((p, second.take(best)))
        at += size
        size = min(2 * size, 4096)


def choose(p: np.ndarray, g: np.ndarray, p_cats: np.ndarray, g_cats: np.ndarray, p_usable: np.ndarray, g_usable: np.ndarray, threshold: float, strict: bool, same_category: bool, how: str) -> list[tuple[int, int]]:
    """Chosen pairs of row numbers; usable: rows that may be chosen at all. The threshold is above 0."""
    out: list = []
    same = True if same_category else None
    if how == "truth":
        n = len(p) - 1
        _in_turn(_Types(g, g_cats, g_usable & sound(g)), _Types(p[::-1], p_cats[::-1], (p_usable & sound(p))[::-1]), threshold, strict, same, False, out)
        return [(n - v, u) for u, v in out]
    first, second = _Types(p, p_cats, p_usable & sound(p)), _Types(g, g_cats, g_usable & sound(g))
    if how == "prediction":
        _in_turn(first, second, threshold, strict, same, False, out)
    elif how == "greedy":
        _best_first(first, second, threshold, strict, same, lambda iou: iou, out)
    else:
        for alike, more in ((True, 0.5),) if same_category else ((True, 0.5), (False, 0.0)):
            # From an overlap of 0.8 all scores are equal: members take their turn.
            _in_turn(first, second, max(threshold, 0.8), strict and threshold >= 0.8, alike, True, out)
            if threshold < 0.8:
                _best_first(first, second, threshold, strict, alike, lambda iou: iou * 0.5 + more, out)  # noqa: B023
    return out


def rivals_suppressed(boxes: np.ndarray, cats: np.ndarray, sized: np.ndarray, limit: float) -> np.ndarray:
    """Which rows stay when each in turn meets the later ones of other classes that overlap it by more than `limit`:
    it goes if one of them has a size and it has none, and those that are not better go."""
    left = np.ones(len(boxes), bool)
    usable, kinds = sound(boxes), int(cats.max(initial=0)) + 1
    at, size, built, index = 0, 256, -1, None
    while at < len(boxes):
        turns = np.arange(at, min(at + size, len(boxes)))
        turns = turns[left[turns] & usable[turns]]
        later = left & usable
        later[:at] = False
        alive = int(later.sum())
        if index is None or alive < 0.9 * built:
            ids = np.flatnonzero(later)
            index, built = _Index(boxes[ids], cats[ids], ids), alive
        asked = np.repeat(turns, kinds)
        groups = np.tile(np.arange(kinds), len(turns))
        other = groups != cats[asked]
        asked, groups = asked[other], groups[other]
        found, held, crowded = [], 0, False
        for u, v, _ in index.pairs(boxes[asked], groups, limit, True):
            u = asked[u]
            fine = (v > u) & left[v]
            found.append((u[fine], v[fine]))
            held += int(fine.sum())
            if held > HELD and size > 1:
                crowded = True
                break
        if crowded:
            size = max(1, size // 2)
            continue
        if found:
            u, v = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(u, kind="stable")
            u, v = u[order], v[order]
            starts = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, int)
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(u)).tolist()):
                k = u[a]
                if left[k]:
                    rivals = v[a:b][left[v[a:b]]]
                    better = rivals[sized[rivals]] if not sized[k] else rivals[:0]
                    left[rivals if not len(better) else rivals[~sized[rivals]]] = False
                    left[k] = not len(better)
        at += size
        size = min(2 * size, 4096)
    return left
