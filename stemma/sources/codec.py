"""The manifest text format as a source and a sink."""

from __future__ import annotations

import datetime as dt
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions.base58 import ALPHABET, LENGTH, digests_of, id_text as text_of_id, is_id, parse_id, texts_of_ids
from stemma.functions.fmt import SEQUENCE, comma_size, format_mode, format_name, format_pretty_ts, format_target, line_without_id, tree_key
from stemma.functions.ident import id_text
from stemma.functions.modes import S_IFMT, TYPE_LETTERS, mode_bits
from stemma.functions.names import raw_name
from stemma.schema import ENTRY, known_digest, latest

_UTC = dt.timezone.utc
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=_UTC)

# A name ends after its slash, or before the blanks that a link, an ID or a lone dash follows.
_STOP = r" +(?:c4.|-(?: |$))"
_NAME = r'(?P<name>(?:\\[ "\[\]\\]|(?! +(?:-> |<- |<> |->[1-9])|' + _STOP + r")[^/])*/?)"
_TARGET = r'(?:\\[ "\\]|(?!' + _STOP + r").)*"
_FLOW = r"(?:(?!" + _STOP + r").)*"
_HEAD = r"(?P<mode>-(?= )|.{10}) (?P<ts>[-0](?= )|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}(?:Z|[+-][0-9:]{5})|(?:\S+ +){4}\S+) +(?P<size>-|[0-9,]+) *" + _NAME + " *"
_LINK_OF_SYMLINK = rf"(?:-> *(?P<target>{_TARGET}))?"
_LINK = rf"""(?:->(?P<group>[1-9][0-9]*)|-> *(?P<out>[^\W\d_][\w-]*:{_FLOW})|->(?P<bare>)(?= *(?:-$|c4| *$))|-> *(?P<target>{_TARGET})|<- *(?P<into>{_FLOW})|<> *(?P<both>{_FLOW}))?"""
_SYMLINK_LINE = re.compile(_HEAD + _LINK_OF_SYMLINK + r" *(?P<rest>.*)", re.S)
_LINE = re.compile(_HEAD + _LINK + r" *(?P<rest>.*)", re.S)
# Most lines: no link, and a name without blanks, escapes, brackets and marks.
_USUAL_LINE = re.compile(rf"""(-|[-dlpsbc][-rwxsStT]{{9}}) ([-0]|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}Z) (-|[0-9]+) ([^ \\"\[\]¤/]+/?) (-|c4[{ALPHABET}]{{88}})""")
_MODE = re.compile(r"[-dlpsbc](?:[r-][w-][xsS-]){2}[r-][w-][xtT-]")


class BadManifest(ValueError):
    """Text that is no manifest, with its line."""


@functools.lru_cache(maxsize=4096)
def mode_of(text: str) -> int | None:
    if text != "-" and not _MODE.fullmatch(text):
        raise ValueError(f"bad mode {text!r}")
    return mode_bits(text)


@functools.lru_cache(maxsize=65_536)
def time_of(text: str) -> dt.datetime | None:
    if text in ("-", "0"):
        return None
    if "T" in text[:11]:
        return _null_epoch(dt.datetime.fromisoformat(text).astimezone(_UTC))
    month, day, clock, year, zone = text.split()
    if zone not in ("UTC", "GMT"):
        raise ValueError(f"time zone {zone!r} isn't unambiguous")
    return _null_epoch(dt.datetime.strptime(f"{month} {day} {clock} {year}", "%b %d %H:%M:%S %Y").replace(tzinfo=_UTC))


def _null_epoch(t: dt.datetime) -> dt.datetime | None:
    return None if t == _EPOCH else t


def _plain(field: str, marks: str) -> str:
    """Field escapes resolved; an escaped backslash stays as it is for the name's own decoding."""
    return re.sub(rf"(\\\\)|\\([{marks}])", lambda m: m[1] or m[2], field)


def _checked(text: str) -> str:
    if not is_id(text):
        parse_id(text)  # raises with the reason
    return text


def entry_of(line: str, read_id=parse_id) -> dict:
    """Fields of an entry line without its indentation; ValueError if it is none. read_id: what becomes of
    the ID's text."""
    if m := _USUAL_LINE.fullmatch(line):
        mode, ts, size, name, rest = m.groups()
        return {
            "name": name, "is_dir": name[-1] == "/", "mode": mode_of(mode), "ts": time_of(ts), "size": None if size == "-" else int(size), "digest": None if rest == "-" else read_id(rest),
            "target": None, "hard_link": 0, "flow_direction": "", "flow_target": None, "is_sequence": False, "pattern": None,
        }
    m = (_SYMLINK_LINE if line.startswith("l") else _LINE).fullmatch(line)
    if not m or not m["name"]:
        raise ValueError("no entry line")
    g = m.groupdict()
    raw, rest = g["name"], g["rest"].strip()
    size = None if g["size"] == "-" else int(g["size"].replace(",", "") or "x")
    flow, where = next(((op, g[k]) for op, k in (("->", "out"), ("<-", "into"), ("<>", "both")) if g.get(k) is not None), ("", None))
    name = raw_name(_plain(raw, r' "\[\]'))
    sequence = bool(re.search(SEQUENCE, re.sub(r"\\.", "", raw, flags=re.S)))
    return {
        "name": name, "is_dir": name.endswith("/"), "mode": mode_of(g["mode"]), "ts": time_of(g["ts"]), "size": size, "digest": read_id(rest) if rest.startswith("c4") else None,
        "target": raw_name(_plain(g["target"], ' "')) if g.get("target") else None, "hard_link": int(g["group"]) if g.get("group") else -1 if g.get("bare") is not None else 0,
        "flow_direction": flow, "flow_target": where, "is_sequence": sequence, "pattern": name if sequence else None,
    }


def entries_of(text: str, read_id=parse_id) -> Iterator[tuple[str, dict]]:
    """("entry", row), ("base", {digest}) and ("list", {text, digests}) of a manifest text, in order.

    Patch sections are numbered from 1, the base is 0; a section starts at a line that is one ID.
    """
    section, ordinal, width, stack, empty, content = 0, 0, 0, [], False, False
    for no, line in enumerate(text.split("\n"), 1):
        try:
            if "\r" in line:
                raise ValueError("carriage return")
            if not line.strip():
                continue
            if line.startswith("@"):
                raise ValueError("directives aren't supported")
            if len(line) == LENGTH and line.startswith("c4"):
                digest = parse_id(line)
                if not content:
                    yield "base", {"digest": digest}
                elif empty:
                    raise ValueError("empty patch section")
                else:
                    section, stack, empty = section + 1, [], True
                content = True
                continue
            if len(line) > LENGTH and len(line) % LENGTH == 0 and all(is_id(line[i : i + LENGTH]) for i in range(0, len(line), LENGTH)):
                yield "list", {"text": line, "digests": [parse_id(line[i : i + LENGTH]) for i in range(0, len(line), LENGTH)]}
                content = True
                continue
            bare = line.lstrip(" ")
            indent = len(line) - len(bare)
            width = width or indent
            row = entry_of(bare, read_id)
            depth = min(indent // width if width else 0, len(stack))
            del stack[depth:]
            parent = "".join(stack)
            yield "entry", row | {"section_idx": section, "ord": ordinal, "path": parent + row["name"], "parent": parent or None, "depth": depth}
            ordinal, empty, content = ordinal + 1, False, True
            if row["is_dir"]:
                stack.append(row["name"])
        except ValueError as e:
            raise BadManifest(f"line {no}: {e}") from e
    if empty:
        raise BadManifest("empty patch section at the end")


_FIELDS = [part.strip().split() for part in ENTRY.split(",")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC"), "binary": pa.binary()}
_ENTRY_ARROW = pa.schema([(n, _ARROW[t]) for n, t in _FIELDS])


def decode(texts: DataFrame, errors: str = "fail") -> DataFrame:
    """Entry rows of (manifest_id, text) rows.

    errors: "fail" raises on a bad text, "skip" leaves bad texts out (see decode_errors). Null texts give
    no rows. Texts are read line by line; rows leave in batches, so a task holds one text.
    """

    def batch(rows):
        for row, digest in zip(rows, digests_of([r["digest"] for r in rows])):
            row["digest"] = digest
        return pa.RecordBatch.from_pylist(rows, schema=_ENTRY_ARROW)

    def run(batches):
        ready = []
        for b in batches:
            for manifest_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                try:
                    for kind, row in entries_of(text or "", _checked):
                        if kind == "entry":
                            rows.append(row | {"manifest_id": manifest_id})
                            if errors == "fail" and len(rows) >= 10_000:
                                yield batch(rows)
                                rows = []
                except BadManifest as e:
                    if errors == "fail":
                        raise BadManifest(f"{manifest_id}, {e}") from e
                    continue
                ready += rows
                if len(ready) >= 10_000:
                    yield batch(ready)
                    ready = []
        if ready:
            yield batch(ready)

    return texts.select("manifest_id", "text").mapInArrow(run, ENTRY)


def decode_errors(texts: DataFrame) -> DataFrame:
    """(manifest_id, message) of texts that are no manifests."""

    @F.pandas_udf(T.StringType())
    def message(text):
        def one(t):
            try:
                for _ in entries_of(t or ""):
                    pass
            except BadManifest as e:
                return str(e)
            return None

        return text.map(one)

    return texts.select("manifest_id", message("text").alias("message")).where("message is not null")


def inline_lists(texts: DataFrame) -> DataFrame:
    """(manifest_id, list_digest, pos, digest): members of inline ID lists; a list's key is its text's ID."""
    import hashlib

    def run(batches):
        for b in batches:
            out = {"manifest_id": [], "list_digest": [], "pos": [], "digest": []}
            for manifest_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, row in entries_of(text or ""):
                    if kind == "list":
                        key = hashlib.sha512(row["text"].encode()).digest()
                        for i, d in enumerate(row["digests"]):
                            for k, v in zip(out, (manifest_id, key, i, d)):
                                out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("manifest_id", pa.string()), ("list_digest", pa.binary()), ("pos", pa.int32()), ("digest", pa.binary())]))

    return texts.select("manifest_id", "text").mapInArrow(run, "manifest_id string, list_digest binary, pos int, digest binary")


# --- writing


def indent() -> Column:
    """Blanks before a line: two a level."""
    return F.repeat(F.lit(" "), F.col("depth") * 2)


def entry_lines(entries: DataFrame) -> DataFrame:
    """(manifest_id, section_idx, path, key, line): indented lines; order by key for the text's order."""
    ids = F.when(known_digest(F.col("digest")), id_text("digest"))
    rows = latest(entries.withColumn("section_idx", F.coalesce("section_idx", F.lit(0))), "manifest_id", "section_idx", "path")
    line = F.concat(indent(), line_without_id(), F.lit(" "), F.coalesce(ids, F.lit("-")))
    return rows.select("manifest_id", "section_idx", "path", tree_key(F.col("path")).alias("key"), line.alias("line"))


def pretty_lines(entries: DataFrame) -> DataFrame:
    """As entry_lines, for reading: sizes with commas and right-aligned, local times, IDs in one column.

    The ID column is 80, or the next multiple of ten that leaves ten blanks after the longest line.
    """
    rows = latest(entries.withColumn("section_idx", F.coalesce("section_idx", F.lit(0))), "manifest_id", "section_idx", "path")
    c = F.col
    link = F.when(F.coalesce(c("target"), F.lit("")) != "", F.concat(F.lit(" -> "), format_target(c("target")))).when(
        (F.coalesce(c("hard_link"), F.lit(0)) == 0) & (F.coalesce(c("flow_direction"), F.lit("")) != ""), F.concat(F.lit(" "), c("flow_direction"), F.lit(" "), c("flow_target"))
    ).otherwise(F.lit(""))
    hard = F.when((F.coalesce(c("target"), F.lit("")) == "") & (c("hard_link") != 0), F.when(c("hard_link") < 0, " ->").otherwise(F.concat(F.lit(" ->"), c("hard_link").cast("string")))).otherwise(F.lit(""))
    time = F.when(c("ts").isNull() | (F.unix_seconds("ts") == 0), F.rpad(F.lit("-"), 25, " ")).otherwise(format_pretty_ts(c("ts")))
    rows = rows.select(
        "manifest_id", "section_idx", "path", "digest", tree_key(c("path")).alias("key"), F.concat(indent(), format_mode(c("mode")), F.lit(" "), time, F.lit(" ")).alias("_a"),
        comma_size(c("size")).alias("_size"), F.concat(F.lit(" "), format_name(c("name"), c("is_sequence")), link).alias("_b"), hard.alias("_hard"),
    )
    widths = rows.groupBy("manifest_id").agg(F.max(F.length("_size")).alias("_w"), F.max(F.length("_a") + F.length("_b")).alias("_len"))
    column = F.greatest(F.lit(80), F.ceil((c("_len") + c("_w") + 10) / 10) * 10)
    body = F.concat("_a", F.lpad("_size", c("_w"), F.lit(" ")), "_b", "_hard")
    padded = F.concat(body, F.repeat(F.lit(" "), F.greatest(F.lit(10), (column - F.length(body)).cast("int"))), F.coalesce(F.when(known_digest(c("digest")), id_text("digest")), F.lit("-")))
    return rows.join(widths, "manifest_id").select("manifest_id", "section_idx", "path", "key", padded.alias("line"))


def dumps(entries: DataFrame, pretty: bool = False) -> str:
    """Text of one manifest's base on the driver, for manifests that fit there."""
    lines = (pretty_lines if pretty else entry_lines)(entries).where("section_idx = 0").orderBy("key").select("line")
    return "".join(r.line + "\n" for r in lines.toLocalIterator())


def write_files(lines: DataFrame, folder: str, ending: str, head: str = "") -> DataFrame:
    """One text file a manifest of (manifest_id, line) rows in a folder all executors share; returns
    (manifest_id, file, lines, bytes). Rows must be partitioned by manifest and sorted. With further columns
    (path, digest) the last of the rows of a path counts, and the digest's ID ends its line.

    Lines are written as they come, so a manifest of any size passes through. A file is written under
    another name and renamed, so a repeated task leaves whole files.
    """
    import os
    import uuid

    def finished(batches) -> Iterator[tuple[str, str]]:
        """(manifest, line): of the rows of a path the last one, with its ID."""
        held = None
        for b in batches:
            if b.num_columns == 2:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                continue
            ids = texts_of_ids(b.column(3).to_pylist())
            for manifest_id, line, path, id_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), ids):
                if held and held[:2] != (manifest_id, path):
                    yield held[0], held[2]
                held = (manifest_id, path, f"{line} {id_ or '-'}")
        if held:
            yield held[0], held[2]

    def run(batches):
        current, f, n, size, tmp = None, None, 0, 0, ""

        def close():
            f.close()
            final = os.path.join(folder, current.replace("/", "_") + ending)
            os.replace(tmp, final)
            return pa.RecordBatch.from_pydict({"manifest_id": [current], "file": [final], "lines": [n], "bytes": [size]})

        for manifest_id, line in finished(batches):
            if manifest_id != current:
                if f:
                    yield close()
                current, n, size, tmp = manifest_id, 0, len(head.encode()), os.path.join(folder, f".{uuid.uuid4().hex}.part")
                f = open(tmp, "wb")  # noqa: SIM115
                f.write(head.encode())
            data = line.encode() + b"\n"
            f.write(data)
            n, size = n + 1, size + len(data)
        if f:
            yield close()

    os.makedirs(folder, exist_ok=True)
    columns = ["manifest_id", "line", *(c for c in ("path", "digest") if c in lines.columns)]
    return lines.select(*columns).mapInArrow(run, "manifest_id string, file string, lines long, bytes long")


def write_texts(entries: DataFrame, folder: str, pretty: bool = False) -> DataFrame:
    """write_files of the bases of manifests. Rows are sent once, by manifest, with their digests; the writer drops
    all but the last row of a path and spells the IDs."""
    base = entries.where(F.coalesce("section_idx", F.lit(0)) == 0) if "section_idx" in entries.columns else entries
    if pretty:
        return write_files(pretty_lines(base).select("manifest_id", "key", "line").repartition("manifest_id").sortWithinPartitions("manifest_id", "key").select("manifest_id", "line"), folder, ".c4m")
    line = F.concat(indent(), line_without_id())
    rows = base.where("path is not null").select("manifest_id", line.alias("line"), "path", F.when(known_digest(F.col("digest")), F.col("digest")).alias("digest"), F.coalesce("ord", F.lit(-(2**62))).alias("ord"))
    # the key is a column, as a sort works out an expression anew for every comparison, but isn't sent along
    keyed = rows.repartition("manifest_id").withColumn("key", tree_key(F.col("path")))
    return write_files(keyed.sortWithinPartitions("manifest_id", "key", "ord"), folder, ".c4m")


def read_texts(spark, path: str) -> DataFrame:
    """(manifest_id, text) of manifest files; manifest_id is the file's name without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.c4m").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract(F.col("path"), r"([^/]+)\.c4m$", 1)
    return files.select(name.alias("manifest_id"), F.decode("content", "UTF-8").alias("text"))


# --- canonical form of single texts, in Python


def _printable(name: str) -> str:
    import unicodedata

    out, pending = [], b""
    for ch in name:
        if ch in _ESCAPED:
            new = _ESCAPED[ch]
        elif ch != "¤" and (unicodedata.category(ch)[0] in "LMNPS" or unicodedata.category(ch) == "Zs"):
            new = ch
        else:
            pending += ch.encode()
            continue
        out += [_signs(pending), new]
        pending = b""
    return "".join([*out, _signs(pending)])


_ESCAPED = {"\0": "\\0", "\t": "\\t", "\n": "\\n", "\r": "\\r", "\\": "\\\\"}


def _signs(raw: bytes) -> str:
    return "¤" + "".join(chr(0x2800 + x) for x in raw) + "¤" if raw else ""


def _field(name: str, marks: str = ' "[]') -> str:
    return re.sub("([" + re.escape(marks) + "])", r"\\\1", _printable(name))


@functools.lru_cache(maxsize=4096)
def _mode_text(mode: int) -> str:
    out = [TYPE_LETTERS.get(mode & S_IFMT, "-")]
    for who, (special, mark) in enumerate(((0o4000, "s"), (0o2000, "s"), (0o1000, "t"))):
        bits = mode >> (6 - 3 * who)
        out += ["r" if bits & 4 else "-", "w" if bits & 2 else "-"]
        out.append((mark if bits & 1 else mark.upper()) if mode & special else "x" if bits & 1 else "-")
    return "".join(out)


def name_field(name: str, sequence: bool) -> str:
    m = re.search(SEQUENCE, name) if sequence else None
    if sequence:
        return _field(name[: m.start()]) + m[0] + _field(name[m.end() :]) if m else name
    return _field(name[:-1]) + "/" if name.endswith("/") else _field(name)


def canonical_text_line(row: dict) -> str:
    """Canonical line of a row as entries_of gives it."""
    ts = row["ts"]
    parts = [_mode_text(row["mode"]) if row["mode"] else "-", ts.strftime("%Y-%m-%dT%H:%M:%SZ") if ts else "-", "-" if row["size"] is None else str(row["size"]), name_field(row["name"], row["is_sequence"])]
    if row["target"]:
        parts += ["->", _field(row["target"], ' "')]
    elif row["hard_link"]:
        parts.append("->" if row["hard_link"] < 0 else f"->{row['hard_link']}")
    elif row["flow_direction"]:
        parts += [row["flow_direction"], row["flow_target"] or ""]
    digest = row["digest"]
    return " ".join([*parts, text_of_id(digest) if digest and any(digest) else "-"])


def natural_order(name: str) -> list:
    return [(1, "", int(x), len(x)) if x[0].isascii() and x[0].isdigit() else (0, x, 0, 0) for x in re.findall("[0-9]+|[^0-9]+", name)]


# What a manifest can begin with: a mode's first letter, or an ID's.
_FIRST = {bytes([x]) for x in b"-dlpsbcrw"}


def looks_like_manifest(content: bytes) -> bool:
    return content.lstrip()[:1] in _FIRST


def canonicalized(content: bytes, limit: int = 10_000_000) -> bytes | None:
    """Canonical bytes of content that is a manifest with at least one entry, else None.

    Content above the limit isn't looked into. Patch sections are no single state, so a text with them
    is not rewritten.
    """
    if len(content) > limit or not looks_like_manifest(content):
        return None
    try:
        rows = [row for kind, row in entries_of(content.decode()) if kind == "entry"]
    except (ValueError, UnicodeDecodeError):
        return None
    if not rows or any(r["section_idx"] for r in rows):
        return None
    rows = list({r["path"]: r for r in rows}.values())
    rows.sort(key=lambda r: [(c.endswith("/"), natural_order(c)) for c in re.findall("[^/]+/?", r["path"])])
    return "".join("  " * r["depth"] + canonical_text_line(r) + "\n" for r in rows).encode()


#: From this size on, content counts as a manifest only if its file is named so.
SNIFF = 10_000_000


def identified(content: bytes, file: str | None = None) -> bytes:
    """Content as it is identified: canonical if it is a manifest, else itself. A file without the ending
    is looked into below SNIFF only; content of no known file is, whatever its size."""
    if isinstance(file, str) and not file.endswith(".c4m") and len(content) >= SNIFF:
        return content
    return canonicalized(content, limit=len(content)) or content


@F.pandas_udf(T.BinaryType())
def identified_bytes(content, file):
    """identified() of columns."""
    return content.combine(file, lambda c, f: None if c is None else identified(c, f))
