"""Loading manifest text lines with the malformed ones set apart.

Lines are parsed into typed columns together, by Arrow and array kernels, which tell for each cell
whether it was read. A block of lines without an unread cell is accepted as it is; another one is
halved until single lines are left, and those are diagnosed field by field.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.base58 import ALPHABET, LENGTH, is_id
from stemma.functions.modes import mode_bits

BLOCK = 64

# Fixed values of the line format.
ESCAPES = {" ": " ", '"': '"', "[": "[", "]": "]", "\\": "\\", "0": "\0", "t": "\t", "n": "\n", "r": "\r"}
REASONS = ("columns", "quoting", "mode", "ts", "size", "c4id")

_MODE = r"[-dlbcps][-rwxstST]{9}"
_TS = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:Z|[+-][0-9]{2}:[0-9]{2})"
_NAME = r'(?:[^ "\\\n]|\\[ "\[\]\\0tnr])+'
# The columns of a line. Only sizes and IDs that can be seen to be in range by their first digits are read here;
# the strict path takes the rest.
_COLUMNS = (
    rf"^ *(?P<mode>-|{_MODE}) (?P<ts>[-0]|{_TS}) (?P<size>-|[0-9]{{1,18}}|[0-9]{{1,3}}(?:,[0-9]{{3}}){{1,5}}) (?P<name>{_NAME})(?: -> (?P<target>{_NAME}))?"
    rf" (?P<c4id>-|c4(?:[1-5][{ALPHABET}]{{87}}|6[1-6][{ALPHABET}]{{86}}))$"
)
_DAY = (
    r"(?:(?!0000)[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    r"|(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)-02-29)"
)
_STRICT_TS = re.compile(_DAY + r"T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])")
_STRICT_MODE = re.compile(_MODE)
_STRICT_SIZE = re.compile(r"[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+")
_FIELD = re.compile(r"(?:[^ \\]|\\.|\\\Z)*", re.S)
_BAD_QUOTE = re.compile(r'(?:[^"\\]|\\[ "\[\]\\0tnr])+')
_ESCAPED = re.compile(r"\\(.)", re.S)


def split_fields(rest: str) -> list[str]:
    """Fields between single spaces; a backslash keeps the next character in its field."""
    out, at = [], 0
    while True:
        end = _FIELD.match(rest, at).end()
        out.append(rest[at:end])
        if end >= len(rest):
            return out
        at = end + 1


def diagnose(line: str | None) -> list[str] | None:
    """Reasons against a line, [] for a valid one, None for one that is no entry (null, blank, IDs only)."""
    rest = (line or "").lstrip(" ")
    if not rest or (len(rest) % LENGTH == 0 and all(is_id(rest[i : i + LENGTH]) for i in range(0, len(rest), LENGTH))):
        return None
    f = split_fields(rest)
    if not (len(f) == 5 or (len(f) == 7 and f[4] == "->")):
        return ["columns"]
    mode, ts, size, cid, names = f[0], f[1], f[2], f[-1], [f[3], f[5]] if len(f) == 7 else [f[3]]
    bad = []
    if not all(_BAD_QUOTE.fullmatch(x) for x in names):
        bad.append("quoting")
    if mode != "-" and not _STRICT_MODE.fullmatch(mode):
        bad.append("mode")
    if ts not in ("-", "0") and not _STRICT_TS.fullmatch(ts):
        bad.append("ts")
    if size != "-" and not (_STRICT_SIZE.fullmatch(size) and len(s := size.replace(",", "").lstrip("0")) <= 19 and int(s or 0) < 2**63):
        bad.append("size")
    if cid != "-" and not is_id(cid):
        bad.append("c4id")
    return bad


def _instants(stamps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds, read) of stamps that have the shape of one; others, null among them, aren't read."""
    n = len(stamps)
    out, read = np.zeros(n, np.int64), np.zeros(n, bool)
    rows = np.flatnonzero(pc.fill_null(pc.greater(pc.utf8_length(stamps), 1), False).to_numpy(zero_copy_only=False))
    if not len(rows):
        return out, read
    text = stamps.take(pa.array(rows))
    number = lambda lo, hi: pc.utf8_slice_codeunits(text, lo, hi).cast(pa.int64()).to_numpy()
    y, mo, d, h, mi, s = (number(*at) for at in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19)))
    zone = pc.utf8_slice_codeunits(text, 19, 25)
    zone = pc.if_else(pc.equal(zone, "Z"), "+00:00", zone)
    part = lambda lo, hi: pc.utf8_slice_codeunits(zone, lo, hi).cast(pa.int64()).to_numpy()
    oh, om = part(1, 3), part(4, 6)
    good = (y >= 1) & (mo >= 1) & (mo <= 12) & (h <= 23) & (mi <= 59) & (s <= 59) & (oh <= 23) & (om <= 59)
    month = ((y - 1970) * 12 + np.where(good, mo, 1) - 1).astype("datetime64[M]")
    first = month.astype("datetime64[D]")
    good &= (d >= 1) & (d <= ((month + 1).astype("datetime64[D]") - first).astype(np.int64))
    west = pc.equal(pc.utf8_slice_codeunits(zone, 0, 1), "-").to_numpy(zero_copy_only=False)
    seconds = (first.astype(np.int64) + d - 1) * 86400 + h * 3600 + mi * 60 + s - np.where(west, -1, 1) * (oh * 3600 + om * 60)
    out[rows], read[rows] = seconds * 1_000_000, good
    return out, read


def parsed(lines: pa.Array) -> tuple[dict[str, pa.Array], np.ndarray]:
    """Typed columns of lines, and which lines have every cell read. The cells of other lines mean nothing."""
    parts = pc.extract_regex(lines.cast(pa.string()), _COLUMNS)
    shaped = pc.is_valid(parts).to_numpy(zero_copy_only=False)
    col = {n: pc.if_else(pa.array(shaped), parts.field(n), None) for n in ("mode", "ts", "size", "name", "target", "c4id")}
    modes = col["mode"].dictionary_encode()
    us, read = _instants(col["ts"])
    none = pc.fill_null(pc.less_equal(pc.utf8_length(col["ts"]), 1), False).to_numpy(zero_copy_only=False)
    size = pc.replace_substring(pc.if_else(pc.equal(col["size"], "-"), None, col["size"]), ",", "").cast(pa.int64())
    columns = {
        "mode": pa.array([None if m is None else mode_bits(m) for m in modes.dictionary.to_pylist()], pa.int32()).take(modes.indices),
        "ts": pa.array(us, mask=~read).cast(pa.timestamp("us", "UTC")),
        "size": size,
        "name": _unescape(col["name"]),
        "target": _unescape(pc.if_else(pc.equal(col["target"], ""), None, col["target"])),
        "c4id": pc.if_else(pc.equal(col["c4id"], "-"), None, col["c4id"]),
    }
    return columns, shaped & (read | none)


def suspects(read: np.ndarray, block: int = BLOCK) -> list[int]:
    """Lines with an unread cell, found by halving the blocks that hold one."""
    unread = np.concatenate([[0], np.cumsum(~read)])
    edges = np.append(np.arange(0, len(read), block), len(read))
    at = unread.tolist()
    out = []
    todo = [(int(lo), int(hi)) for lo, hi in zip(edges, edges[1:]) if unread[hi] > unread[lo]]
    while todo:
        lo, hi = todo.pop()
        if hi - lo == 1:
            out.append(lo)
            continue
        mid = (lo + hi) // 2
        todo += [(a, b) for a, b in ((lo, mid), (mid, hi)) if at[b] > at[a]]
    return sorted(out)


def strict_columns(line: str) -> dict:
    """Cells of a valid line that the column parse left out: large sizes and IDs, names with line breaks."""
    f = split_fields(line.lstrip(" "))
    plain = lambda x: _ESCAPED.sub(lambda m: ESCAPES[m[1]], x)
    us, read = _instants(pa.array([f[1]]))
    return {
        "mode": mode_bits(f[0]), "ts": int(us[0]) if read[0] else None, "size": None if f[2] == "-" else int(f[2].replace(",", "")),
        "name": plain(f[3]), "target": plain(f[5]) if len(f) == 7 else None, "c4id": None if f[-1] == "-" else f[-1],
    }


def _unescape(col: pa.Array) -> pa.Array:
    """Names with their escapes resolved; only names that hold a backslash are touched."""
    has = pc.fill_null(pc.match_substring(col, "\\"), False)
    if not pc.any(has).as_py():
        return col
    fixed = [_ESCAPED.sub(lambda m: ESCAPES[m[1]], x) for x in col.filter(has).to_pylist()]
    return pc.replace_with_mask(col, has, pa.array(fixed, pa.string()))


_TYPED = {"mode": pa.int32(), "ts": pa.timestamp("us", "UTC"), "size": pa.int64(), "name": pa.string(), "target": pa.string(), "c4id": pa.string()}
SCHEMA = "line_id long, valid boolean, reasons array<string>, mode int, ts timestamp, size long, name string, target string, c4id string"


def load_lines(lines: DataFrame, columns: bool = True) -> DataFrame:
    """Every line with its verdict, one row a line.

    valid: true with the typed columns; false with ``reasons``; null for lines that are no entry
    (null, blank, nothing but IDs). columns=False leaves the typed columns null, for reading the
    verdicts only; the lines are parsed all the same. No shuffle; blocks never span tasks. Very long lines
    are read whole.
    """

    def run(batches):
        for batch in batches:
            text = batch.column(1)
            cells, read = parsed(text)
            told = {i: diagnose(text[i].as_py()) for i in suspects(read)}
            fine = [i for i, reasons in told.items() if reasons == []]
            valid, reasons = read.astype(object), np.full(len(text), None, dtype=object)
            for i, why in told.items():
                valid[i] = None if why is None else why == []
                reasons[i] = why or None
            out = {"line_id": batch.column(0), "valid": pa.array(valid, pa.bool_()), "reasons": pa.array(reasons, pa.list_(pa.string()))}
            if columns:
                strict = [strict_columns(text[i].as_py()) for i in fine]
                place = np.full(len(text), -1)  # of each valid line: among the parsed ones, then among those read strictly
                place[read] = np.flatnonzero(read)
                place[fine] = np.arange(len(fine)) + len(text)
                for name, kind in _TYPED.items():
                    extra = pa.array([c[name] for c in strict], pa.int64() if name == "ts" else kind).cast(kind)
                    both = pa.concat_arrays([cells[name].cast(kind), extra])
                    out[name] = both.take(pa.array(np.maximum(place, 0), mask=place < 0))
            else:
                out |= {n: pa.nulls(len(text), t) for n, t in _TYPED.items()}
            yield pa.RecordBatch.from_pydict(out)

    return lines.select("line_id", "line").mapInArrow(run, SCHEMA)


def rejected(lines: DataFrame) -> DataFrame:
    """(line_id, reason): one row for each reason against a line."""
    return load_lines(lines, columns=False).where("valid = false").select("line_id", F.explode("reasons").alias("reason"))


