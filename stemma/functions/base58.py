"""Content ID text: ``c4`` and 88 base58 digits of a 64-byte digest."""

from __future__ import annotations

import re

import numpy as np

# Fixed values of the identifier format.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
PREFIX, DIGITS, LENGTH = "c4", 88, 90

_LETTERS = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
_VALUES = np.full(256, -1, dtype=np.int16)
_VALUES[_LETTERS] = np.arange(58)
_STEP = 58**5


def encode_digests(raw: np.ndarray) -> np.ndarray:
    """(n, 64) uint8 digests -> (n, 90) uint8 ID text, by long division of 32-bit limbs by 58**5."""
    n = len(raw)
    limbs = raw.reshape(n, 16, 4).astype(np.uint64)
    limbs = (limbs[:, :, 0] << np.uint64(24)) | (limbs[:, :, 1] << np.uint64(16)) | (limbs[:, :, 2] << np.uint64(8)) | limbs[:, :, 3]
    out = np.empty((n, LENGTH), dtype=np.uint8)
    out[:, 0], out[:, 1] = ord("c"), ord("4")
    at = LENGTH
    for _ in range(18):  # 18 groups of 5 digits; the last group holds 3
        rest = np.zeros(n, dtype=np.uint64)
        for i in range(16):
            both = (rest << np.uint64(32)) | limbs[:, i]
            limbs[:, i], rest = both // np.uint64(_STEP), both % np.uint64(_STEP)
        for _ in range(5):
            if at == 2:
                break
            at -= 1
            out[:, at] = _LETTERS[(rest % np.uint64(58)).astype(np.intp)]
            rest //= np.uint64(58)
    return out


def decode_texts(text: np.ndarray) -> np.ndarray:
    """(n, 90) uint8 text of valid IDs -> (n, 64) uint8 digests: the inverse, by 32-bit limbs times 58**5."""
    n = len(text)
    digits = _VALUES[text[:, 2:]].astype(np.uint64)
    limbs = np.zeros((n, 16), dtype=np.uint64)
    at = 0
    for width in (3, *[5] * 17):
        carry = np.zeros(n, dtype=np.uint64)
        for i in range(at, at + width):
            carry = carry * np.uint64(58) + digits[:, i]
        at += width
        for i in range(15, -1, -1):
            both = limbs[:, i] * np.uint64(58**width) + carry
            limbs[:, i], carry = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    return limbs.astype(">u4").view(np.uint8).reshape(n, 64)


def id_text(digest: bytes) -> str:
    """ID text of one digest; for many, encode_digests is faster."""
    value, out = int.from_bytes(digest), []
    for _ in range(DIGITS):
        value, digit = divmod(value, 58)
        out.append(ALPHABET[digit])
    return PREFIX + "".join(reversed(out))


#: The largest valid ID. Digits sort as their ASCII letters, so IDs compare as text.
MAX_ID = id_text(b"\xff" * 64)
_SHAPE = re.compile(f"{PREFIX}[{ALPHABET}]{{{DIGITS}}}")


def is_id(s: str) -> bool:
    return bool(_SHAPE.fullmatch(s)) and s <= MAX_ID


def texts_of_ids(digests: list[bytes | None]) -> list[str | None]:
    """ID texts of many digests at once; None for None and for what hasn't 64 bytes."""
    at = [i for i, d in enumerate(digests) if d is not None and len(d) == 64]
    out: list[str | None] = [None] * len(digests)
    if at:
        text = encode_digests(np.frombuffer(b"".join([digests[i] for i in at]), dtype=np.uint8).reshape(-1, 64)).tobytes().decode()
        for k, i in enumerate(at):
            out[i] = text[LENGTH * k : LENGTH * k + LENGTH]
    return out


def digests_of(texts: list[str | None]) -> list[bytes | None]:
    """Digests of many ID texts at once; None for None and for what is no ID."""
    at = [i for i, s in enumerate(texts) if s is not None and is_id(s)]
    out: list[bytes | None] = [None] * len(texts)
    if at:
        raw = decode_texts(np.frombuffer("".join([texts[i] for i in at]).encode(), dtype=np.uint8).reshape(-1, LENGTH)).tobytes()
        for k, i in enumerate(at):
            out[i] = raw[64 * k : 64 * k + 64]
    return out


def parse_id(s: str) -> bytes:
    """Digest of an ID; ValueError names what is wrong with it."""
    if len(s) != LENGTH:
        raise ValueError(f"an ID has {LENGTH} characters, not {len(s)}")
    if not s.startswith(PREFIX):
        raise ValueError("an ID starts with c4")
    value = 0
    for ch in s[2:]:
        digit = _VALUES[ord(ch)] if ord(ch) < 256 else -1
        if digit < 0:
            raise ValueError(f"{ch!r} is no base58 digit")
        value = value * 58 + int(digit)
    if value >> 512:
        raise ValueError("the ID's value is above 512 bits")
    return value.to_bytes(64, "big")
