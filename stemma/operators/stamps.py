"""Timestamps of many notations brought to UTC microseconds.

A stamp's shape mask has every digit as 0 and every letter as a. Each distinct mask is matched
against the notations once and gives the places of its fields; all stamps of a mask are then
converted together by slicing a character matrix, and local times go through zone transition
tables. The driver's zone data version is checked on the workers.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import zones

# Month names as written in stamps, and zone letters that always mean UTC.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
UTC_LETTERS = ("UTC", "GMT")

_CLOCK = r"(?P<h>00?):(?P<mi>00)(?::(?P<s>00)(?:[.,](?P<f>0+))?)?"
_OFFSET = r"(?P<sign>[+-])(?P<oh>00)(?::?(?P<om>00))?"
_ZONE = rf"(?: ?{_OFFSET}| ?(?P<z>a)| (?P<abbr>a{{2,5}})| ?\[(?P<abbr2>a{{2,5}})\]| (?P<region>a+(?:[/_+-][a0]+)+)| ?\[(?P<region2>a+(?:[/_+-][a0]+)+)\])"
# Notations as patterns over masks.
NOTATIONS = tuple(
    re.compile(p)
    for p in (
        rf"(?P<y>0000)(?P<sep>[-/.])(?P<mo>00)(?P=sep)(?P<d>00)(?:(?P<t>[a ]){_CLOCK}{_ZONE}?)?",
        rf"(?P<mo>00?)/(?P<d>00?)/(?P<y>0000)(?: {_CLOCK}(?: ?(?P<ap>aa))?)?",
        rf"(?P<d>00?)\.(?P<mo>00?)\.(?P<y>0000)(?: {_CLOCK}{_ZONE}?)?",
        rf"(?:(?P<wd>a+), ?)?(?P<d>00?)[ -](?P<mon>a{{3,9}})[ -](?P<y>0000)(?: {_CLOCK}{_ZONE}?)?",
        rf"(?P<mon>a{{3,9}}) {{1,2}}(?P<d>00?),? {_CLOCK} (?P<y>0000){_ZONE}?",
        rf"(?P<wd>a{{3}}) (?P<mon>a{{3,9}}) {{1,2}}(?P<d>00?) {_CLOCK}{_ZONE}? (?P<y>0000)",
        rf"(?P<mon>a{{3,9}}) {{1,2}}(?P<d>00?), (?P<y>0000)(?: {_CLOCK}{_ZONE}?)?",
        rf"(?P<y>0000)(?P<mo>00)(?P<d>00)(?:(?P<t>[a ])(?P<h>00)(?P<mi>00)(?:(?P<s>00)(?:[.,](?P<f>0+))?)?{_ZONE}?)?",
        r"(?P<y>0000)(?P<mo>00)(?P<d>00)(?P<h>00)(?P<mi>00)(?:(?P<s>00)(?P<f>0*))?",
    )
)
#: Digits of a count since the epoch, and microseconds a unit.
COUNTS = {10: 1_000_000, 13: 1_000, 16: 1}
_COUNT = re.compile(r"(?P<n>0{10}|0{13}|0{16})(?:[.,](?P<f>0+))?")


@functools.lru_cache(maxsize=65536)
def parser_for(mask: str) -> dict[str, tuple[int, int]] | None:
    """Field places of a mask, None if no notation has it."""
    m = _COUNT.fullmatch(mask)
    if m and (m["f"] is None or len(m["n"]) == 10):
        return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    for p in NOTATIONS:
        if m := p.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since the epoch of civil dates (m in 1..12)."""
    months = (y - 1970) * 12 + (m - 1)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    start = ((y - 1970) * 12 + (m - 1)).astype("datetime64[M]")
    return ((start + 1).astype("datetime64[D]") - start.astype("datetime64[D]")).astype(np.int64)


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


def _micros(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """Fraction digits as microseconds, digits beyond dropped."""
    lo, hi = span
    hi = min(hi, lo + 6)
    return _number(chars, (lo, hi)) * 10 ** (6 - (hi - lo)) if hi > lo else np.zeros(len(chars), np.int64)


def _texts(chars: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = span
    part = np.ascontiguousarray(chars[:, lo:hi]).view(f"U{hi - lo}").ravel()
    return np.unique(part, return_inverse=True)


def convert(stamps: np.ndarray, place: dict[str, tuple[int, int]], site_zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds, valid) of stamps that share a mask. site_zone: zone names, '' where unknown."""
    n = len(stamps)
    width = stamps.dtype.itemsize // 4
    chars = stamps.view(np.uint32).reshape(n, width)
    valid = np.ones(n, dtype=bool)
    if "n" in place:
        us = _number(chars, place["n"]) * COUNTS[place["n"][1] - place["n"][0]]
        if "f" in place:
            us = us + _micros(chars, place["f"])
        return us, valid & (us != 0)

    num = lambda k: _number(chars, place[k])
    y, d = num("y"), num("d")
    if "mon" in place:
        names, which = _texts(chars, place["mon"])
        index = {m: i + 1 for months in (MONTHS, LONG_MONTHS) for i, m in enumerate(months)}
        mo = np.array([index.get(str(x).lower(), 0) for x in names], dtype=np.int64)[which]
    else:
        mo = num("mo")
    valid &= (mo >= 1) & (mo <= 12) & (y >= 1)
    safe_mo = np.where(valid, mo, 1)
    safe_y = np.where(valid, y, 1970)
    valid &= (d >= 1) & (d <= _month_length(safe_y, safe_mo))
    h = num("h") if "h" in place else np.zeros(n, np.int64)
    mi = num("mi") if "mi" in place else np.zeros(n, np.int64)
    s = num("s") if "s" in place else np.zeros(n, np.int64)
    us = _micros(chars, place["f"]) if "f" in place else np.zeros(n, np.int64)
    if "ap" in place:
        halves, which = _texts(chars, place["ap"])
        half = np.array([{"am": 0, "pm": 12}.get(str(x).lower(), -1) for x in halves], dtype=np.int64)[which]
        valid &= (half >= 0) & (h >= 1) & (h <= 12)
        h = h % 12 + half
    if "t" in place:
        lo = place["t"][0]
        valid &= np.isin(chars[:, lo], [ord("T"), ord("t"), ord(" ")])
    if "wd" in place:
        days, which = _texts(chars, place["wd"])
        known = np.array([str(x).lower()[:3] in ("mon", "tue", "wed", "thu", "fri", "sat", "sun") for x in days])
        valid &= known[which]
    valid &= (h <= 23) & (mi <= 59) & (s <= 59)
    local = _days(safe_y, safe_mo, np.where(valid, d, 1)) * 86400 + h * 3600 + mi * 60 + s

    if "sign" in place:
        oh, om = num("oh"), num("om") if "om" in place else np.zeros(n, np.int64)
        valid &= (oh <= 23) & (om <= 59)
        offset = (oh * 3600 + om * 60) * np.where(chars[:, place["sign"][0]] == ord("-"), -1, 1)
        utc = local - offset
    elif "z" in place:
        valid &= np.isin(chars[:, place["z"][0]], [ord("Z"), ord("z")])
        utc = local
    else:
        zone, called = site_zone, None
        for key in ("abbr", "abbr2"):
            if key in place:
                letters, which = _texts(chars, place[key])
                called = letters[which]
                zone = np.where(np.isin(letters, UTC_LETTERS)[which], "UTC", site_zone)
        for key in ("region", "region2"):
            if key in place:
                names, which = _texts(chars, place[key])
                zone = names[which]
        utc = np.zeros(n, np.int64)
        for name in np.unique(zone):
            rows = zone == name
            got = zones.local_to_utc(local[rows], str(name), None if called is None else called[rows]) if name else None
            if got is None:
                valid &= ~rows
            else:
                utc[rows] = got
    us = utc * 1_000_000 + us
    return us, valid & (us != 0)


SCHEMA = "stamp_id long, utc_us long"


def normalise_stamps(stamps: DataFrame, sites: DataFrame) -> DataFrame:
    """(stamp_id, utc_us) of each stamp that denotes an instant; the others are left out.

    Null, empty and unreadable stamps, stamps without a zone at a site of unknown zone or at a site
    that isn't listed denote none. Repeated records each give their row. Zone letters mean the site's
    zone; in a repeated hour they choose the reading that has this name, without them the first holds.
    """
    version = zones.tz_version()

    def run(batches):
        if zones.tz_version() != version:
            raise RuntimeError(f"zone data here is {zones.tz_version()}, the driver's is {version}")
        for batch in batches:
            masks = batch.column(2).dictionary_encode()
            codes = masks.indices.to_numpy(zero_copy_only=False)
            text = batch.column(1)
            zone = pc.fill_null(batch.column(3), "").dictionary_encode()
            zone = np.array(zone.dictionary.to_pylist(), dtype=str)[zone.indices.to_numpy()] if len(batch) else np.zeros(0, "U1")
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(masks.dictionary) + 1))
            ids, out = [], []
            for k, mask in enumerate(masks.dictionary.to_pylist()):
                place = parser_for(mask)
                rows = order[cuts[k] : cuts[k + 1]]
                if place is None or not len(rows):
                    continue
                us, valid = convert(np.array(text.take(pa.array(rows)).to_pylist(), dtype=f"U{len(mask)}"), place, zone[rows])
                ids.append(rows[valid])
                out.append(us[valid])
            if ids:
                yield pa.RecordBatch.from_pydict({"stamp_id": batch.column(0).take(pa.array(np.concatenate(ids))), "utc_us": pa.array(np.concatenate(out), pa.int64())})

    one = sites.groupBy("site_id").agg(F.min("tz").alias("_tz"))
    trimmed = F.regexp_replace("stamp", r"(?U)^\s+|\s+$", "").alias("_text")
    letters = "bcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = stamps.where(F.col("stamp").isNotNull()).select("stamp_id", "site_id", trimmed)
    # one call: digits 1-9 to 0, letters to a
    mask = F.translate("_text", "123456789" + letters, "0" * 9 + "a" * len(letters)).alias("_mask")
    rows = rows.join(one, "site_id", "left").select("stamp_id", "_text", mask, "_tz")
    return rows.mapInArrow(run, SCHEMA)
