"""Column helpers on POSIX modes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File type bits of st_mode.
S_IFMT, S_IFREG, S_IFDIR, S_IFLNK = 0o170000, 0o100000, 0o040000, 0o120000
# File types and their letters in mode strings; regular files have a dash and no type bit.
TYPE_LETTERS = {0o040000: "d", 0o120000: "l", 0o010000: "p", 0o140000: "s", 0o060000: "b", 0o020000: "c"}
LETTER_TYPES = {"-": 0} | {letter: bits for bits, letter in TYPE_LETTERS.items()}
NULL_MODE = "-" * 10


def mode_bits(text: str) -> int | None:
    """st_mode of a mode string without a regular-file bit; null for ``-`` and ten dashes. A letter that isn't
    at its place sets nothing."""
    if text in ("-", NULL_MODE):
        return None
    bits = LETTER_TYPES[text[0]]
    for i, ch in enumerate(text[1:]):
        who, what = divmod(i, 3)
        if ch == "rwx"[what] or (what == 2 and ch in "st"):
            bits |= 0o400 >> i
        if what == 2 and ch in ("tT" if who == 2 else "sS"):
            bits |= 0o4000 >> who
    return bits


def canonical_mode(mode: Column) -> Column:
    """Mode with the regular-file bit dropped, so that 0o100644 equals 0o644; other types stay."""
    regular = mode.bitwiseAND(F.lit(S_IFMT)) == F.lit(S_IFREG)
    return F.when(regular, mode.bitwiseAND(F.lit(0o7777))).otherwise(mode)


def whole_seconds(ts: Column) -> Column:
    """Seconds since the epoch, fraction dropped (towards the past)."""
    return F.unix_seconds(ts)
