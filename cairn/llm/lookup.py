"""A vectorised map from 64-bit keys to their positions."""

from __future__ import annotations

import numpy as np

from .common import shipped

shipped(__name__)
NONE = np.uint64(2**64 - 2)


class Lookup:
    """Tables addressed by a hash; each further one holds what found its slot taken in those before."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(4 * max(len(keys), 1)).bit_length())
        self.shift, self.tables = np.uint64(64 - bits), []
        rest, factor = np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(rest):
            k = (keys[rest] * np.uint64(factor) >> self.shift).astype(np.int64)
            _, first = np.unique(k, return_index=True)
            table, at = np.full(1 << bits, NONE, np.uint64), np.full(1 << bits, -1, np.int32)
            table[k[first]], at[k[first]] = keys[rest[first]], rest[first]
            self.tables.append((np.uint64(factor), table, at))
            rest = np.setdiff1d(rest, rest[first])
            factor = factor * 0x5851F42D4C957F2D + 2 & 2**64 - 1 | 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for keys that are not there."""
        out = np.full(keys.shape, -1, np.int32)
        for factor, table, at in self.tables:
            k = (keys * factor >> self.shift).astype(np.int64)
            out = np.where(table[k] == keys, at[k], out)
        return out
