"""Compressed sets of (key, period) and bitmaps over dictionary codes.

Plain numpy functions for Arrow batches. A set travels as the sorted distinct entries' differences in the
narrowest integers, compressed (`pack`); where sets of one key range meet, their keys are coded by a
sorted dictionary, and the codes of one period form a container: the sorted codes themselves where
they are few, a bitset where they are many (`container`, `and_not`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A container with more than one code in so many is a bitset.
SPARSE = 16
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    top = int(values.max(initial=0))
    at = next(i for i, t in enumerate(_WIDTHS) if top <= np.iinfo(t).max)
    return at, values.astype(_WIDTHS[at]).tobytes()


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Keys in ascending order with a value each (both int64, at least one) as compressed bytes."""
    least = int(values.min())
    k, differences = _narrow(keys[1:].view(np.uint64) - keys[:-1].view(np.uint64))
    v, offsets = _narrow(values.view(np.uint64) - np.int64(least).view(np.uint64))
    raw = np.array([len(keys), int(keys[0]), least, k, v], np.int64).tobytes() + differences + offsets
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) as given to `pack`."""
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n, first, least, k, v = np.frombuffer(raw, np.int64, 5).tolist()
    differences = np.frombuffer(raw, _WIDTHS[k], n - 1, 40).astype(np.uint64)
    offsets = np.frombuffer(raw, _WIDTHS[v], n, 40 + differences.size * np.dtype(_WIDTHS[k]).itemsize).astype(np.uint64)
    keys = np.cumsum(np.r_[np.int64(first).view(np.uint64), differences], dtype=np.uint64).view(np.int64)
    return keys, (offsets + np.int64(least).view(np.uint64)).view(np.int64)


def distinct(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, sorted by key, then value."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    return keys[new], values[new]


def least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, with the least value of each."""
    keys, values = distinct(keys, values)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], values[new]


def bitset(codes: np.ndarray, size: int) -> np.ndarray:
    """A bit per code from 0 to `size` - 1, eight to a byte."""
    flags = np.zeros(size, bool)
    flags[codes] = True
    return np.packbits(flags, bitorder="little")


def container(codes: np.ndarray, size: int) -> np.ndarray:
    """Sorted codes below `size` in the smaller form: as they are (int64) or as a bitset (uint8)."""
    return codes.astype(np.int64, copy=False) if len(codes) * SPARSE <= size else bitset(codes, size)


def and_not(held: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The codes of a container whose bit in the bitset `known` is not set."""
    if held.dtype == np.uint8:
        return np.flatnonzero(np.unpackbits(held & ~known, bitorder="little"))
    return held[(known[held >> 3] >> (held & 7).astype(np.uint8)) & 1 == 0]
