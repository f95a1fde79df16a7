"""Text forms of entry fields as plain columns, and the natural order of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.modes import NULL_MODE, S_IFMT, TYPE_LETTERS


def _bit(mode: Column, bit: int) -> Column:
    return mode.bitwiseAND(F.lit(bit)) != 0


def format_mode(mode: Column) -> Column:
    """Ten characters; null and 0 are ten dashes."""
    kind = mode.bitwiseAND(F.lit(S_IFMT))
    letter = reduce(lambda c, x: c.when(kind == x[0], F.lit(x[1])), TYPE_LETTERS.items(), F.when(kind == 0o100000, F.lit("-"))).otherwise(F.lit("-"))
    parts = [letter]
    for who, (special, mark) in enumerate(((0o4000, "s"), (0o2000, "s"), (0o1000, "t"))):
        shift = 6 - 3 * who
        parts += [F.when(_bit(mode, 4 << shift), "r").otherwise("-"), F.when(_bit(mode, 2 << shift), "w").otherwise("-")]
        run, also = _bit(mode, 1 << shift), _bit(mode, special)
        parts.append(F.when(also & run, mark).when(also, mark.upper()).when(run, "x").otherwise("-"))
    return F.when(mode.isNull() | (mode == 0), F.lit(NULL_MODE)).otherwise(F.concat(*parts))


def parse_mode(text: Column) -> Column:
    """st_mode without a regular-file bit; null for ``-``, ten dashes and text that is no mode."""
    kind = F.substring(text, 1, 1)
    total = reduce(lambda c, x: c.when(kind == x[1], F.lit(x[0])), TYPE_LETTERS.items(), F.when(kind == "-", F.lit(0)))
    for who, special in enumerate((0o4000, 0o2000, 0o1000)):
        shift = 6 - 3 * who
        r, w, x = (F.substring(text, 2 + 3 * who + i, 1) for i in range(3))
        mark = "t" if who == 2 else "s"
        total = total + F.when(r == "r", 4 << shift).otherwise(0) + F.when(w == "w", 2 << shift).otherwise(0)
        total = total + F.when(x == "x", 1 << shift).when(x == mark, (1 << shift) | special).when(x == mark.upper(), special).otherwise(0)
    valid = text.rlike("^[-dlpsbc](?:[r-][w-][xsS-]){2}[r-][w-][xtT-]\\z") & (text != NULL_MODE)
    return F.when(valid, total)


def format_ts(ts: Column) -> Column:
    """UTC seconds with Z; null and the epoch are ``-``. The session's zone must be UTC."""
    return F.when(ts.isNull() | (F.unix_seconds(ts) == 0), F.lit("-")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def format_pretty_ts(ts: Column) -> Column:
    """``Mon _d HH:MM:SS YYYY ZONE`` in the session's zone."""
    return F.concat(F.date_format(ts, "MMM "), F.lpad(F.date_format(ts, "d"), 2, " "), F.date_format(ts, " HH:mm:ss yyyy z"))


def parse_ts(text: Column) -> Column:
    """Timestamp of a field: with Z, with an offset, or in the pretty form with UTC or GMT; else null."""
    pretty = F.regexp_replace(F.regexp_replace(text, " +", " "), r" (UTC|GMT)\z", "")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.when(text.rlike("^[A-Z][a-z]{2} "), F.try_to_timestamp(pretty, F.lit("MMM d HH:mm:ss yyyy"))),
    )


def format_size(size: Column) -> Column:
    return F.when(size.isNull() | (size < 0), F.lit("-")).otherwise(size.cast("string"))


def comma_size(size: Column) -> Column:
    return F.when(size.isNull() | (size < 0), F.lit("-")).otherwise(F.format_number(size, 0))


def human_size(size: Column) -> Column:
    """1024-based units, one decimal beyond bytes."""
    out = F.when(F.abs(size) < 1024, F.format_string("%d B", size))
    for i, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = out.when(F.abs(size) < float(1024 ** (i + 1)), F.format_string(f"%.1f {unit}", size / float(1024**i)))
    return F.when(size.isNotNull(), out.otherwise(F.format_string("%.1f EB", size / float(1024**6))))


def escape_field(safe: Column) -> Column:
    """Backslash before blanks, quotes and square brackets."""
    return F.regexp_replace(safe, r'([ "\[\]])', r"\\$1")


def unescape_field(text: Column) -> Column:
    return F.regexp_replace(text, r'(\\\\)|\\([ "\[\]])', "$1$2")


_PRINTABLE = r"\p{L}\p{M}\p{N}\p{P}\p{S}\p{Zs}"
_HIDDEN_RUN = rf"(?:(?![\t\n\r\x00\\])[^{_PRINTABLE}]|¤)+"


def _braille(run: Column) -> Column:
    """The bytes of a run as U+2800 + byte, between currency signs."""
    pairs = F.regexp_extract_all(F.hex(F.encode(run, "UTF-8")), F.lit("(..)"), F.lit(1))

    def sign(h):
        b = F.conv(h, 16, 10).cast("int")
        return F.concat(F.lit("E2"), F.hex(F.shiftright(b, 6) + 0xA0), F.hex(b.bitwiseAND(F.lit(63)) + 0x80))

    return F.concat(F.lit("¤"), F.decode(F.unhex(F.array_join(F.transform(pairs, sign), "")), "UTF-8"), F.lit("¤"))


def safe_name(raw: Column) -> Column:
    """Printable form of a raw name.

    Letters, marks, numbers, punctuation, symbols and blanks stay; NUL, tab, line ends and the backslash
    become backslash escapes; runs of anything else, and of the currency sign, become their UTF-8 bytes as
    Braille patterns between currency signs. Stays in the JVM; names without such characters pay for
    one pattern match.
    """
    hidden = raw.rlike(_HIDDEN_RUN)
    pieces = F.regexp_extract_all(raw, F.lit(rf"(?s)({_HIDDEN_RUN}|(?:(?!{_HIDDEN_RUN}).)+)"), F.lit(1))
    spelt = F.when(hidden, F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(rf"^{_HIDDEN_RUN}\z"), _braille(p)).otherwise(p)), "")).otherwise(raw)
    escaped = F.replace(spelt, F.lit("\\"), F.lit("\\\\"))
    for ch, code in (("\x00", "\\0"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(ch), F.lit(code))
    return F.when(hidden | raw.rlike(r"[\\\x00\t\n\r]"), escaped).otherwise(raw)


# A run of digits with ranges, in brackets that no backslash escapes.
SEQUENCE = r"\[[0-9,:\-]+\]"


def is_sequence(raw: Column) -> Column:
    """Whether a name as written in a line has a frame range in unescaped brackets."""
    return F.regexp_replace(raw, r"(?s)\\.", "").rlike(SEQUENCE)


def format_name(name: Column, sequence: Column) -> Column:
    """Name field: printable and escaped; a directory's slash and a sequence's first range stay."""
    base, slash = F.regexp_replace(name, r"/\z", ""), F.when(name.endswith("/"), "/").otherwise("")
    usual = F.concat(escape_field(safe_name(base)), slash)
    before = F.regexp_extract(name, rf"(?s)^(.*?){SEQUENCE}", 1)
    span = F.regexp_extract(name, f"({SEQUENCE})", 1)
    after = F.substring(name, F.length(before) + F.length(span) + 1, F.length(name))
    ranged = F.when(span == "", name).otherwise(F.concat(escape_field(safe_name(before)), span, escape_field(safe_name(after))))
    return F.when(F.coalesce(sequence, F.lit(False)), ranged).otherwise(usual)


def format_target(target: Column) -> Column:
    return F.regexp_replace(safe_name(target), r'([ "])', r"\\$1")


def line_without_id() -> Column:
    """Canonical entry line up to and without its last field. Reads the entry columns of the frame."""
    c = F.col
    link = (
        F.when(F.coalesce(c("target"), F.lit("")) != "", F.concat(F.lit(" -> "), format_target(c("target"))))
        .when(F.coalesce(c("hard_link"), F.lit(0)) < 0, F.lit(" ->"))
        .when(F.coalesce(c("hard_link"), F.lit(0)) > 0, F.concat(F.lit(" ->"), c("hard_link").cast("string")))
        .when(F.coalesce(c("flow_direction"), F.lit("")) != "", F.concat(F.lit(" "), c("flow_direction"), F.lit(" "), F.coalesce(c("flow_target"), F.lit(""))))
        .otherwise(F.lit(""))
    )
    mode = F.when(F.coalesce(c("mode"), F.lit(0)) == 0, F.lit("-")).otherwise(format_mode(c("mode")))
    return F.concat(mode, F.lit(" "), format_ts(c("ts")), F.lit(" "), format_size(c("size")), F.lit(" "), format_name(c("name"), c("is_sequence")), link)


def canonical_line(id_column: Column) -> Column:
    """Canonical entry line. id_column: ID text, null for none."""
    return F.concat(line_without_id(), F.lit(" "), F.coalesce(id_column, F.lit("-")))


# Marks in order keys: the end of a piece of text (a NUL in it is written apart from that) and of a component.
_END_TEXT, _NUL, _END_NAME = "\x00\x00", "\x00\x01", "\x00"


def natural_key(component: Column) -> Column:
    """Text that orders names: text before numbers, numbers by value and then the shorter spelling.

    Each piece is spelt so that plain comparison of the keys is that of the pieces one by one.
    """

    def part(x):
        digits = F.regexp_replace(x, "^0+", "")
        width = lambda c: F.lpad(F.length(c).cast("string"), 10, "0")
        number = F.concat(F.lit("1"), width(digits), digits, width(x))
        return F.when(x.rlike("^[0-9]"), number).otherwise(F.concat(F.lit("0"), F.replace(x, F.lit("\x00"), F.lit(_NUL)), F.lit(_END_TEXT)))

    return F.array_join(F.transform(F.regexp_extract_all(component, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), part), "")


def tree_key(path: Column) -> Column:
    """Text that orders whole paths: depth first, files before directories, natural order of names."""
    from stemma.schema import components

    return F.array_join(F.transform(components(path), lambda y: F.concat(F.when(y.endswith("/"), "1").otherwise("0"), natural_key(y), F.lit(_END_NAME))), "")
