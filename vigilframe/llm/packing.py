"""Blocks of numbers as compressed bytes, and words as numbers."""

from __future__ import annotations

import numpy as np
import zstandard


class Numbers(dict):
    """Numbers its keys in the order they come."""

    def __missing__(self, key):
        self[key] = out = len(self)
        return out


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as compressed bytes, their bytes of equal weight together."""
    planes = [np.array([len(a) for a in arrays], np.uint64).tobytes()]
    planes += [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def expanded(data: bytes, *types) -> list[np.ndarray]:
    raw, out = zstandard.ZstdDecompressor().decompress(data), []
    sizes, at = np.frombuffer(raw, np.uint64, len(types)).tolist(), 8 * len(types)
    for kind, size in zip(types, sizes):
        wide = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * wide, at).reshape(wide, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * wide
    return out
