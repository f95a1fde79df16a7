"""Golomb-coded sets with the first occurrence of each key.

Key hashes are reduced to a range 2**bits, sorted, and cut into blocks of equal hash span. A block
stores the gaps of its sorted values with Rice codes (quotients in unary, remainders in k bits, k
fitted to the block), and for each value a number of its own width: when the key first occurred.
"""

from __future__ import annotations

import math

import numpy as np


def _packed(values: np.ndarray, width: int) -> bytes:
    if width == 0 or not len(values):
        return b""
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    return np.packbits(((values.astype(np.uint64)[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()


def _unpacked(raw: bytes, n: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, dtype=np.int64)
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n * width).reshape(n, width)
    out = np.zeros(n, dtype=np.int64)
    for i in range(width):
        out = (out << 1) | bits[:, i]
    return out


def encode_block(values: np.ndarray, base: int, span_bits: int, notes: np.ndarray) -> dict:
    """values: distinct, ascending, in [base, base + 2**span_bits). notes: a number >= 0 for each."""
    n = len(values)
    gaps = np.diff(values, prepend=base - 1) - 1
    k = max(0, int(math.log2(max(1.0, 2.0**span_bits / n * math.log(2)))))
    quotients = gaps >> k
    unary = np.zeros(int(quotients.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    width = int(notes.max()).bit_length() if n else 0
    return {"n": n, "k": k, "width": width, "unary": np.packbits(unary).tobytes(), "rest": _packed(gaps & ((1 << k) - 1), k), "notes": _packed(notes, width)}


def decode_block(block: dict, base: int) -> tuple[np.ndarray, np.ndarray]:
    n, k = block["n"], block["k"]
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(block["unary"], dtype=np.uint8)))[:n]
    quotients = np.diff(ones, prepend=-1) - 1
    gaps = (quotients << k) | _unpacked(block["rest"], n, k)
    return np.cumsum(gaps + 1) + (base - 1), _unpacked(block["notes"], n, block["width"])
