"""Bloom filters of bounded size, built by the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, frugal_group
from .textblocks import mix

#: Bits of a filter: 16 per member, at most 2**27 (16 MB).
BLOOM_BITS = 27
_U = np.uint64


def _spots(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = mix(tokens ^ _U(0x5BF0363546F01A2B))
    return (m & _U((1 << bits) - 1)).astype(np.int64), (m >> _U(64 - bits)).astype(np.int64)


def in_filter(bloom: np.ndarray, bits: int, tokens: np.ndarray) -> np.ndarray:
    a, b = _spots(tokens, bits)
    return ((bloom[a >> 3] >> (a & 7).astype(np.uint8)) & (bloom[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def bloom_filter(tokens: DataFrame, column: str, size: int, most_bits: int = BLOOM_BITS) -> tuple[np.ndarray, int]:
    """Bloom filter of a long column, at most 2**most_bits bits: built in segments by the executors, joined by the driver."""
    bits = int(np.clip(int(np.ceil(np.log2(max(size, 1) * 16))), 16, most_bits))
    segment = min(bits, 20)

    @frugal

    def spots(batches):
        held, size = [], 0

        def flush():
            a, c = _spots(np.concatenate(held).view(_U), bits)
            spot = np.unique(np.concatenate([a, c]))
            part = spot >> segment
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            low = (spot & ((1 << segment) - 1)).astype(np.uint32)
            ends = np.append(cut[1:], len(spot))
            return pa.RecordBatch.from_arrays(
                [pa.array(part[cut].astype(np.int32)), pa.array([low[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())], ["seg", "part"]
            )

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            size += len(held[-1])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    @frugal_group

    def joined(key, rows):
        on = np.zeros(1 << segment, np.uint8)
        for part in rows.column(1):
            on[np.frombuffer(part.as_buffer(), np.uint32)] = 1
        own = np.packbits(on, bitorder="little").tobytes()
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([own], pa.binary())], ["seg", "part"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    rows = tokens.select(F.col(column)).mapInArrow(spots, "seg int, part binary").groupBy("seg").applyInArrow(joined, "seg int, part binary")
    for seg, part in rows.collect():
        out[seg << (segment - 3) : (seg + 1) << (segment - 3)] = np.frombuffer(part, np.uint8)
    return out, bits
