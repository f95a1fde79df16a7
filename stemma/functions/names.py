"""Decoding of printable names back to raw ones."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The backslash escapes of printable names.
ESCAPES = {"0": b"\0", "t": b"\t", "n": b"\n", "r": b"\r", "\\": b"\\"}
_CODED = re.compile("\\\\([0tnr\\\\])|¤([⠀-⣿]+)¤")


def raw_bytes(name: str) -> bytes:
    """Bytes of the raw name; unknown escapes and stray currency signs stand for themselves."""
    out, at = [], 0
    for m in _CODED.finditer(name):
        out += [name[at : m.start()].encode(), ESCAPES[m[1]] if m[1] else bytes(ord(ch) - 0x2800 for ch in m[2])]
        at = m.end()
    return b"".join([*out, name[at:].encode()])


def raw_name(name: str) -> str:
    """Raw name; one whose bytes aren't UTF-8 keeps its printable form, its bytes are in raw_bytes()."""
    if "\\" not in name and "¤" not in name:
        return name
    try:
        return raw_bytes(name).decode()
    except UnicodeDecodeError:
        return name


@F.pandas_udf(T.StringType())
def unsafe_name(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else raw_name(n))


@F.pandas_udf(T.BinaryType())
def unsafe_name_bytes(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else raw_bytes(n))
