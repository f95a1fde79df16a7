"""Stamps against a reading with datetime and zoneinfo, one by one."""

import datetime as dt
import re
import zoneinfo

import pytest

from stemma.functions.zones import local_to_utc, transitions
from stemma.operators.stamps import normalise_stamps

UTC = dt.timezone.utc
EPOCH = dt.datetime(1970, 1, 1, tzinfo=UTC)
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
DATES = (
    r"(?P<y>\d{4})[-/](?P<mo>\d\d)[-/](?P<d>\d\d)", r"(?P<mo>\d\d)/(?P<d>\d\d)/(?P<y>\d{4})", r"(?P<d>\d\d)\.(?P<mo>\d\d)\.(?P<y>\d{4})", r"(?:[A-Z][a-z]{2}, )?(?P<d>\d{1,2}) (?P<b>[A-Z][a-z]{2}) (?P<y>\d{4})",
)
CLOCK = r"(?P<h>\d\d):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?"
ZONE = r"(?: ?(?P<off>[+-]\d\d:?\d\d)|(?P<z>Z)| (?P<l>[A-Z]{3,4})| ?\[?(?P<r>[A-Z]\w+/\w+)\]?|\[(?P<u>UTC)\])?"
SHAPES = [re.compile(f"{d}(?:[T ]{CLOCK}(?: (?P<ap>[AP]M))?{ZONE})?") for d in DATES] + [
    re.compile(rf"(?P<b>[A-Z][a-z]{{2}})  ?(?P<d>\d{{1,2}}) {CLOCK} (?P<y>\d{{4}}){ZONE}"),
    re.compile(rf"[A-Z][a-z]{{2}} (?P<b>[A-Z][a-z]{{2}})  ?(?P<d>\d{{1,2}}) {CLOCK} (?P<l>[A-Z]{{3,4}}) (?P<y>\d{{4}})"),
    re.compile(r"(?P<y>\d{4})(?P<mo>\d\d)(?P<d>\d\d)(?:T?(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?P<z>Z)?)?"),
]


def read(stamp, site):
    """Microseconds of one stamp, None if it denotes no instant."""
    s = (stamp or "").strip()
    if m := re.fullmatch(r"(\d{10})(?:\.(\d+))?", s):
        us = int(m[1]) * 10**6 + int((m[2] or "0").ljust(6, "0")[:6])
        return us or None
    if re.fullmatch(r"\d{13}|\d{16}", s):
        return int(s) * (1000 if len(s) == 13 else 1) or None
    m = next((m for p in SHAPES if (m := p.fullmatch(s))), None)
    if not m:
        return None
    g = {k: v for k, v in m.groupdict().items() if v}
    try:
        h = int(g.get("h", 0))
        if "ap" in g:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if g["ap"] == "PM" else 0)
        month = MONTHS.index(g["b"]) + 1 if "b" in g else int(g["mo"])
        t = dt.datetime(int(g["y"]), month, int(g["d"]), h, int(g.get("mi", 0)), int(g.get("s", 0)), int(g.get("f", "0").ljust(6, "0")[:6]))
    except ValueError:
        return None
    if "off" in g:
        o = g["off"].replace(":", "")
        t = t.replace(tzinfo=dt.timezone((1 if o[0] == "+" else -1) * dt.timedelta(hours=int(o[1:3]), minutes=int(o[3:]))))
    elif "z" in g or "u" in g or g.get("l") in ("UTC", "GMT"):
        t = t.replace(tzinfo=UTC)
    else:
        name = g.get("r", site)
        if name is None:
            return None
        first, second = (t.replace(tzinfo=zoneinfo.ZoneInfo(name), fold=k) for k in (0, 1))  # fold 0: first reading; offset before a gap
        t = second if g.get("l") == second.tzname() != first.tzname() and second.utcoffset() < first.utcoffset() else first
    return (t.astimezone(UTC) - EPOCH) // dt.timedelta(microseconds=1) or None


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_against_single_readings(spark, folder):
    d = f"/root/testdata/{folder}"
    stamps, sites = spark.read.parquet(f"{d}/scan_stamps.parquet"), spark.read.parquet(f"{d}/sites.parquet")
    tz = {r.site_id: r.tz for r in sites.collect()}
    want = {r.stamp_id: us for r in stamps.collect() if (us := read(r.stamp, tz.get(r.site_id))) is not None}
    assert {r.stamp_id: r.utc_us for r in normalise_stamps(stamps, sites).collect()} == want


CASES = [
    ("2024-11-03 01:30:00", 1, "2024-11-03T05:30:00"), ("2024-03-10 02:30:00", 1, "2024-03-10T07:30:00"), ("2024-04-07 01:45:00", 8, "2024-04-06T14:45:00"),
    ("2024-11-03 01:30:00 EST", 1, "2024-11-03T06:30:00"), ("2024-11-03 01:30:00 EDT", 1, "2024-11-03T05:30:00"), ("2024-11-03 01:30:00 XYZ", 1, "2024-11-03T05:30:00"), ("2024-11-03 00:59:59 EST", 1, "2024-11-03T04:59:59"),
    ("Nov 3 01:06:44 2024 EST", 1, "2024-11-03T06:06:44"), ("2024-03-10 02:30:00 EDT", 1, "2024-03-10T07:30:00"), ("2150-07-01 12:00:00", 1, "2150-07-01T16:00:00"), ("9000-01-01 12:00:00", 1, "9000-01-01T17:00:00"),
    ("12/31/2024 12:00 AM", 7, "2024-12-31T00:00:00"), ("12/31/2024 12:00 PM", 7, "2024-12-31T12:00:00"), ("12/31/2024 13:00 PM", 7, None), ("31.12.2024", 7, "2024-12-31T00:00:00"), ("13/31/2024", 7, None),
    ("2023-02-29", 7, None), ("2024-02-29", 7, "2024-02-29T00:00:00"), ("2024-02-29T24:00:00Z", 7, None), ("2024-02-29T10:60:00Z", 7, None), ("0", 7, None), ("-", 7, None), ("", 7, None), (None, 7, None), ("1970-01-01T00:00:00Z", 7, None), ("0000000000", 7, None),
    ("20240229", 7, "2024-02-29T00:00:00"), ("20240229101112", 3, "2024-02-29T04:41:12"), ("2024-02-29T10:11:12", 10, None), ("2024-02-29T10:11:12 EST", 10, None), ("2024-02-29T10:11:12 GMT", 10, "2024-02-29T10:11:12"), ("2024-02-29T10:11:12[Asia/Tokyo]", 10, "2024-02-29T01:11:12"),
    ("2024-02-29T10:11:12", 99, None), ("2024-02-29T10:11:12 Nowhere/Town", 7, None), ("2024-02", 7, None), ("2024-", 7, None), ("16.06. 09:25", 7, None), (" 2024-02-29T10:11:12.1234567Z\n", 7, "2024-02-29T10:11:12.123456"), ("x" * 100_000, 7, None), ("２０２４-02-29", 7, None),
]


def test_cases(spark):
    sites = spark.createDataFrame([(1, "America/New_York", "x"), (3, "Asia/Kolkata", "x"), (7, "UTC", "x"), (8, "Australia/Lord_Howe", "x"), (10, None, "x")], "site_id int, tz string, stamp string")
    df = spark.createDataFrame([(i, s, t, "c") for i, (t, s, _) in enumerate(CASES)], "stamp_id long, site_id int, stamp string, tz string")
    got = {r.stamp_id: r.utc_us for r in normalise_stamps(df, sites).collect()}
    want = {i: (dt.datetime.fromisoformat(w).replace(tzinfo=UTC) - EPOCH) // dt.timedelta(microseconds=1) for i, (_, _, w) in enumerate(CASES) if w}
    assert got == want
    assert normalise_stamps(df.limit(0), sites).count() == 0
    assert normalise_stamps(df, sites.limit(0)).count() == 3  # those that carry their zone


def test_transitions_agree_with_zoneinfo():
    import numpy as np

    for name in ("America/New_York", "Europe/Dublin", "Australia/Lord_Howe", "Pacific/Apia", "Africa/Casablanca", "UTC"):
        z = zoneinfo.ZoneInfo(name)
        local = [dt.datetime(2011, 1, 1) + dt.timedelta(minutes=47 * i) for i in range(12_000)]
        local += [dt.datetime(1850, 1, 1) + dt.timedelta(days=149, hours=7) * i for i in range(19_000)]  # until after the year 9000
        want = [int((t.replace(tzinfo=z, fold=0).astimezone(UTC) - EPOCH).total_seconds()) for t in local]
        secs = np.array([int((t.replace(tzinfo=UTC) - EPOCH).total_seconds()) for t in local])
        assert local_to_utc(secs, name).tolist() == want
    assert transitions("No/Such") is None
