"""Content-defined anchors: the least hash of every stretch of consecutive positions."""

from __future__ import annotations

import numpy as np

_LOW = np.uint64(0xFFFFFF)


def least_positions(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each i the position in `hashes[i:i + span]` of the least value (its upper 40 bits; the first of equals).

    The choice depends on the stretch alone, so equal stretches anywhere choose equal positions.
    Takes at most 2**24 values.
    """
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(hashes) > 1 << 24:
        half = len(hashes) // 2
        return np.concatenate([least_positions(hashes[:half + span - 1], span),
                               least_positions(hashes[half:], span) + half])
    tagged = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    # minima from block starts forwards and from block ends backwards, then of the two
    whole = -(-len(hashes) // span) * span
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(hashes)] = tagged
    grid = padded.reshape(-1, span)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[:n], forward[span - 1:span - 1 + n]) & _LOW).astype(np.int64)
