"""Once-seen and twice-seen Bloom filters over a distributed table of keys.

A key sets two bits, taken from the halves of its 64-bit hash. Every task reports the bits that
it met once and more than once, by blocks of 2^16 bits and as short lists or plain bitmaps,
whichever is smaller; blocks merge as ``twice = t1 | t2 | (o1 & o2)``. A key that was inserted
twice anywhere has both bits in the twice-seen filter, so no repeat is missed. The result has a
fixed size, ``2 ** bits`` bits, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textwarden.llm.common import map_batches

BLOCK = 16
_BYTES = (1 << BLOCK) // 8
#: bits of a filter: 2 ** 26, that is 8 MiB
BITS = 26
#: a task reports when it holds this many positions
HELD = 1 << 22


def positions(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The two bit positions of each 64-bit hash, as a matrix of two rows."""
    mask = np.uint64((1 << bits) - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask])


def _pack(low: np.ndarray) -> bytes:
    if 2 * len(low) < _BYTES:
        return low.astype(np.uint16).tobytes()
    dense = np.zeros(1 << BLOCK, np.uint8)
    dense[low] = 1
    return np.packbits(dense, bitorder="little").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if len(data) == _BYTES:
        return np.frombuffer(data, np.uint8)
    dense = np.zeros(1 << BLOCK, np.uint8)
    dense[np.frombuffer(data, np.uint16)] = 1
    return np.packbits(dense, bitorder="little")


def _report(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    found, counts = np.unique(np.concatenate(held), return_counts=True)
    blocks, starts = np.unique(found >> np.uint64(BLOCK), return_index=True)
    edges = [*starts, len(found)]
    once, twice = [], []
    for a, b in zip(edges, edges[1:]):
        low, many = (found[a:b] & np.uint64((1 << BLOCK) - 1)).astype(np.int64), counts[a:b] > 1
        once.append(_pack(low[~many]))
        twice.append(_pack(low[many]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(blocks.astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
        ["block", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; holds the two bitmaps of one block."""
    block, once, twice = None, None, None

    def result():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([twice.tobytes()], pa.binary())],
                                          ["block", "twice"])

    for batch in batches:
        for b, o, t in zip(*(c.to_pylist() for c in batch.columns)):
            if b != block:
                if block is not None and twice.any():
                    yield result()
                block, once, twice = b, np.zeros(_BYTES, np.uint8), np.zeros(_BYTES, np.uint8)
            o, t = _unpack(o), _unpack(t)
            twice = twice | t | (once & o)
            once = once | o
    if block is not None and twice.any():
        yield result()


def twice_seen(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int = BITS) -> np.ndarray:
    """The twice-seen filter of the keys that ``hashes`` yields for each batch, as packed bits."""
    def report(batches):
        held, size = [], 0
        for batch in batches:
            found = positions(hashes(batch), bits).ravel()
            held.append(found)
            size += len(found)
            if size >= HELD:
                yield from _report(held)
                held, size = [], 0
        yield from _report(held)

    merged = map_batches(
        map_batches(df, report, "block int, once binary, twice binary").repartition("block")
        .sortWithinPartitions("block"), _merge, "block int, twice binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in merged.collect():  # at most 2 ** (bits - 16) rows of 8 KiB
        out[row.block * _BYTES:(row.block + 1) * _BYTES] = np.frombuffer(row.twice, np.uint8)
    return out


def holds(bitmap: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether both bits of each hash are set."""
    at = positions(hashes, bits)
    found = (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return found.all(axis=0)
