"""Vectorised minimal perfect hashing of 64-bit keys."""

from __future__ import annotations

import numpy as np

from shelfwise.llm import hashing


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: keys alone in their slot of a level's table stay there, the others go to
    the next, smaller table. A key's value is its rank among all taken slots, so n keys have the values 0 to n - 1."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        left, taken = keys, 0
        for factor in hashing.constants(64, 29):
            if not len(left):
                break
            bits = max(4, int(len(left) * 2 - 1).bit_length())
            shift = np.uint64(64 - bits)
            slot = (left * factor) >> shift
            alone = np.bincount(slot.astype(np.int64), minlength=1 << bits) == 1
            rank = np.where(alone, taken + np.cumsum(alone) - 1, -1).astype(np.int32)
            self.levels.append((factor, shift, rank))
            taken += int(alone.sum())
            left = left[~alone[slot]]
        if len(left):
            raise ValueError("keys are not distinct")

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key of the set; any value, or -1, for other keys."""
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for factor, shift, rank in self.levels:
            found = rank[(keys[left] * factor) >> shift]
            out[left] = found
            left = left[found < 0]
            if not len(left):
                break
        return out
