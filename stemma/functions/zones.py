"""Zone transition tables for vectorised local-to-UTC conversion."""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo
from dataclasses import dataclass
from pathlib import Path

import numpy as np

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
#: The table runs from before any zone had a change to 2500. Later years follow the zone's rule, which
#: repeats with the calendar's cycle of 400 years.
_FIRST = int((dt.datetime(1800, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds())
_LAST = int((dt.datetime(2500, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds())
_CYCLE = 146_097 * 86_400


def tz_version() -> str:
    """Version of the zone data in use, so that workers can be held to the driver's."""
    for folder in zoneinfo.TZPATH:
        p = Path(folder, "tzdata.zi")
        if p.exists():
            with p.open() as f:
                return "system " + f.readline().removeprefix("# version ").strip()
    try:
        import importlib.metadata

        return "package " + importlib.metadata.version("tzdata")
    except Exception:
        return "system " + ",".join(zoneinfo.TZPATH)


def _at(zone: zoneinfo.ZoneInfo, t: int) -> dt.datetime:
    return (_EPOCH + dt.timedelta(seconds=t)).astimezone(zone)


def _offset(zone: zoneinfo.ZoneInfo, t: int) -> int:
    return int(_at(zone, t).utcoffset().total_seconds())


@dataclass(frozen=True)
class Transitions:
    """offsets[j] holds for local seconds below thresholds[j]; letters[j] is what the zone calls it.

    A threshold is the local time at which a change is over on either clock, so that a repeated hour is
    read by its first reading and a skipped hour with the offset before the change. repeated[j]: from
    this local time to thresholds[j] the clock shows the same times again, with offsets[j + 1].
    """

    thresholds: np.ndarray
    offsets: np.ndarray
    repeated: np.ndarray
    letters: np.ndarray


@functools.lru_cache(maxsize=1024)
def transitions(name: str) -> Transitions | None:
    """The table of a zone, None if there is no such zone."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None
    thresholds, repeated, offsets, letters = [], [], [], []
    t, before = _FIRST, _offset(zone, _FIRST)
    while t < _LAST:
        nxt = t + 7 * 86400
        after = _offset(zone, nxt)
        if after != before:
            lo, hi = t, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(zone, mid) == before else (lo, mid)
            thresholds.append(hi + max(before, after))
            repeated.append(hi + after)
            offsets.append(before)
            letters.append(_at(zone, lo).tzname())
            before = after
        t = nxt
    as_int = lambda x: np.array(x, dtype=np.int64)
    return Transitions(as_int(thresholds), as_int([*offsets, before]), as_int([*repeated, _LAST + _CYCLE]), np.array([*letters, _at(zone, t).tzname()]))


def local_to_utc(local: np.ndarray, name: str, letters: np.ndarray | None = None) -> np.ndarray | None:
    """UTC seconds of local seconds in a zone, None if there is no such zone.

    letters: zone letters beside each time. In a repeated hour they choose the second reading if it, and
    not the first, is called so; else they say nothing.
    """
    table = transitions(name)
    if table is None:
        return None
    cycles = np.maximum(0, -((_LAST - _CYCLE // 400 - local) // _CYCLE))
    folded = local - cycles * _CYCLE
    j = np.searchsorted(table.thresholds, folded, side="right")
    offset = table.offsets[j]
    if letters is not None:
        k = np.minimum(j + 1, len(table.offsets) - 1)
        second = (folded >= table.repeated[j]) & (letters == table.letters[k]) & (letters != table.letters[j])
        offset = np.where(second, table.offsets[k], offset)
    return local - offset
