"""Arrow batches as blocks of bytes, and vectorised words and shingles over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: One odd number per byte value: bytes enter hashes through this table.
_BYTE = np.random.RandomState(7).randint(0, 1 << 62, 256).astype(_U) * _U(4) + _U(3)
_POW = {"up": np.ones(1, _U), "down": np.ones(1, _U)}
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): fixed constants."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, BLOCK + 1), base, _U)
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
    return _POW["up"][:n], _POW["down"][:n]


def blocks(batch: pa.RecordBatch, column: int = 1, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) of whole texts, about `size` bytes each; null text is empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at, n = 0, len(texts)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums S with S[j] - S[i] times down[i] a hash of bytes i to j, wherever they stand; and `down`."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return sums, down


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space after lower-casing A-Z: (starts, ends, 64-bit hashes, words before each document)."""
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begin[edges] = inside[edges]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    inner = edges[edges > 0] - 1
    stop[inner] = inside[inner]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sums, down = prefix_hashes(_LOWER[data])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    return starts, ends, hashes, np.searchsorted(starts, offsets, "left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document end to end, and offsets. A document of fewer words
    is one shingle; one without words has none."""
    _, _, h, at = words(data, offsets)
    count = np.diff(at)
    short = (count > 0) & (count < n)
    take = np.where(short, 1, np.maximum(count - n + 1, 0))
    bounds = np.append(0, np.cumsum(take))
    out = np.empty(bounds[-1], _U)
    weight = _powers(n + 1)[0]
    if len(h) >= n:
        rolled = np.zeros(len(h) - n + 1, _U)
        for k in range(n):
            rolled += h[k : k + len(rolled)] * weight[k]
        rolled = mix(rolled)
    for d in np.flatnonzero(count >= n):
        part = rolled[at[d] : at[d + 1] - n + 1].copy()
        part.sort()
        out[bounds[d] : bounds[d + 1]] = part
    for d in np.flatnonzero(short):
        part = h[at[d] : at[d + 1]]
        out[bounds[d]] = mix((part * weight[: len(part)]).sum(dtype=_U, keepdims=True) + _U(len(part)))[0]
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][take > 0]] = True
    kept = np.append(0, np.cumsum(new))[bounds]
    return out[new], kept
