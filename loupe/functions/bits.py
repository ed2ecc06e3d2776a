"""Regrouping the bits of 64-bit perceptual hashes, for keys made of parts of them.

The 8 x 8 bits of a hash are regrouped along diagonals, which changes no distance:
a new byte has one bit of each row and of each column of the picture, so that flat
rows or columns, or hashes whose last bits are cut off, do not make one part of the
hash equal everywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three exchanges that transpose 8 x 8 bits: (shift, bits that move down).
_SWAPS = ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0))


def regrouped(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes with their bits regrouped along diagonals: row r turned by r bits, then transposed."""
    rows = hashes.astype(np.uint64).view(np.uint8).reshape(-1, 8)
    turn = np.arange(8, dtype=np.uint8)
    x = np.ascontiguousarray((rows << turn) | (rows >> ((8 - turn) & 7)) * (turn > 0)).view(np.uint64).ravel()
    for shift, mask in _SWAPS:
        moved = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ moved ^ (moved << np.uint64(shift))
    return x


def _moves() -> dict[int, int]:
    """By distance that bits move upwards: the bits that do."""
    bits = regrouped(np.uint64(1) << np.arange(64, dtype=np.uint64))
    moves: dict[int, int] = {}
    for at, to in enumerate(np.bitwise_count(bits - np.uint64(1)).tolist()):
        moves[to - at] = moves.get(to - at, 0) | 1 << at
    return moves


def regrouped_column(hash: Column | str) -> Column:  # noqa: A002
    """``regrouped`` of a BIGINT column: bits that move equally far move together."""
    h = F.col(hash) if isinstance(hash, str) else hash
    out = F.lit(0).cast("long")
    for far, mask in _moves().items():
        some = h.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))
        out = out.bitwiseOR(F.shiftleft(some, far) if far >= 0 else F.shiftrightunsigned(some, -far))
    return out
