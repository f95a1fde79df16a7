"""Compressed bitmaps over 32-bit ordinals, in 2**16-wide containers.

A container is kept as sorted 16-bit values while sparse and as packed bits when dense, so a bitmap
takes at most about 2 bytes a member or 8 KB per 65,536 ordinals.
"""

from __future__ import annotations

import numpy as np

_WIDTH = 1 << 16
_SPARSE = 4096


def _pack(low: np.ndarray):
    if len(low) <= _SPARSE:
        return low
    bits = np.zeros(_WIDTH, dtype=bool)
    bits[low] = True
    return np.packbits(bits)


def _members(c: np.ndarray) -> np.ndarray:
    return c if c.dtype == np.uint16 else np.flatnonzero(np.unpackbits(c)).astype(np.uint16)


class OrdinalBitmap:
    """Immutable set of ordinals with AND and AND-NOT."""

    def __init__(self, containers: dict[int, np.ndarray]):
        self._c = containers

    @classmethod
    def of(cls, ordinals: np.ndarray) -> "OrdinalBitmap":
        o = np.unique(np.asarray(ordinals, dtype=np.uint32))
        high = (o >> 16).astype(np.int64)
        cuts = np.flatnonzero(np.diff(high)) + 1
        out = {}
        for part in np.split(o, cuts):
            if len(part):
                out[int(part[0] >> 16)] = _pack((part & 0xFFFF).astype(np.uint16))
        return cls(out)

    def _combine(self, other: "OrdinalBitmap", keep_common: bool) -> "OrdinalBitmap":
        out = {}
        for k, a in self._c.items():
            b = other._c.get(k)
            if b is None:
                if not keep_common:
                    out[k] = a
                continue
            if a.dtype == np.uint8 and b.dtype == np.uint8:
                low = np.flatnonzero(np.unpackbits(a & b if keep_common else a & ~b)).astype(np.uint16)
            elif b.dtype == np.uint8:
                hit = (b[a >> 3] >> (7 - (a & 7))) & 1
                low = a[hit == (1 if keep_common else 0)]
            else:
                low = (np.intersect1d if keep_common else np.setdiff1d)(_members(a), b, assume_unique=True)
            if len(low):
                out[k] = _pack(low.astype(np.uint16))
        return OrdinalBitmap(out)

    def __and__(self, other: "OrdinalBitmap") -> "OrdinalBitmap":
        return self._combine(other, True)

    def andnot(self, other: "OrdinalBitmap") -> "OrdinalBitmap":
        return self._combine(other, False)

    def dumps(self) -> bytes:
        """Bytes to store: the number of containers, then each one's place, kind and members, then their contents."""
        head = np.array([(k, c.dtype == np.uint8, len(c)) for k, c in sorted(self._c.items())], dtype=np.int32).reshape(-1, 3)
        return np.int32(len(head)).tobytes() + head.tobytes() + b"".join(c.tobytes() for _, c in sorted(self._c.items()))

    @classmethod
    def loads(cls, raw: bytes) -> "OrdinalBitmap":
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        at, out = 4 + 12 * n, {}
        for k, dense, size in np.frombuffer(raw, np.int32, 3 * n, 4).reshape(-1, 3).tolist():
            kind = np.uint8 if dense else np.uint16
            out[k] = np.frombuffer(raw, kind, size, at)
            at += out[k].nbytes
        return cls(out)

    def ordinals(self) -> np.ndarray:
        if not self._c:
            return np.zeros(0, dtype=np.int64)
        return np.concatenate([_members(c).astype(np.int64) + (k << 16) for k, c in sorted(self._c.items())])

    def __len__(self) -> int:
        return sum(len(c) if c.dtype == np.uint16 else int(np.unpackbits(c).sum()) for c in self._c.values())

    def nbytes(self) -> int:
        return sum(c.nbytes for c in self._c.values())
