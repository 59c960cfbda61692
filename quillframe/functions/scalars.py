"""String, number, date, path and URI functions as Column expressions.

Every function takes and returns Columns, so Catalyst plans them with the rest of the
query; the few that no SQL expression can state are Arrow UDFs in ``udfs``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- trimming, spacing, case ---------------------------------------------------------


def trim(x: Column) -> Column:
    """All white space off both ends (SQL trim takes blanks only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def ltrim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+", "")


def rtrim(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+$", "")


def normalize_space(x: Column) -> Column:
    return trim(F.regexp_replace(x, r"\s+", " "))


def sentence_case(x: Column, force_rest: bool = False) -> Column:
    rest = F.substring(x, 2, 1 << 30)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(rest) if force_rest else rest)


def title_case(x: Column, force_rest: bool = False) -> Column:
    """First letter of each word upper; a word starts after anything but a letter, digit, mark or apostrophe."""
    parts = F.split(x, r"(?<![\p{L}\p{M}\p{N}_'’])(?=[\p{L}\p{N}_])")
    return F.array_join(F.transform(parts, lambda p: sentence_case(p, force_rest)), "")


def is_upper(x: Column) -> Column:
    return x.rlike(r"^\p{Lu}")


def is_lower(x: Column) -> Column:
    return x.rlike(r"^\p{Ll}")


def is_capitalized(x: Column) -> Column:
    return x.rlike(r"^\p{Lu}[^\p{Lu}]*$")


def safe_substring(x: Column, start: int, length: int) -> Column:
    """0-based; out of range gives the empty string; a negative start counts from the end."""
    if start < 0:
        return F.when(F.length(x) >= -start, F.substring(x, start, length)).otherwise(F.lit(""))
    return F.substring(x, start + 1, length)


# --- padding (never truncates) -------------------------------------------------------


def _fill(n: Column, pad: str) -> Column:
    return F.repeat(F.lit(pad), F.greatest(n, F.lit(0)).cast("int"))


def _quoted(x: Column, quote: str) -> Column:
    return F.concat(F.lit(quote), x, F.lit(quote)) if quote else x


def lpad(x: Column, width: int, pad: str = "0", quote: str = "") -> Column:
    x = _quoted(x.cast("string"), quote)
    return F.concat(_fill(F.lit(width) - F.length(x), pad), x)


def rpad(x: Column, width: int, pad: str = " ", quote: str = "") -> Column:
    x = _quoted(x.cast("string"), quote)
    return F.concat(x, _fill(F.lit(width) - F.length(x), pad))


def cpad(x: Column, width: int, pad: str = " ", quote: str = "") -> Column:
    """Centred; an odd blank goes to the right."""
    x = _quoted(x.cast("string"), quote)
    gap = F.greatest(F.lit(width) - F.length(x), F.lit(0))
    return F.concat(_fill(F.floor(gap / 2), pad), x, _fill(F.ceil(gap / 2), pad))


def group_thousands(x: Column, width: int = 0, pad: str = " ") -> Column:
    """Integer with commas, left-padded."""
    return lpad(F.format_number(x.cast("long"), 0), width, pad)


def align(x: Column, width: int, how: str = "L", truncate: bool = False, nil: str = "") -> Column:
    """L, R, C, D (decimal point to the middle) or A (numbers right, others left); over-width values stay unless truncated."""
    x = F.coalesce(x.cast("string"), F.lit(nil))
    number = x.rlike(r"^\s*[-+]?\d+(\.\d+)?([Ee][-+]?\d+)?\s*$")
    point = F.when(F.instr(x, ".") > 0, F.instr(x, ".") - 1).otherwise(F.length(x))
    forms = {
        "L": rpad(x, width),
        "R": lpad(x, width, " "),
        "C": cpad(x, width),
        "D": rpad(F.concat(_fill(F.lit(width // 2) - point, " "), x), width),
        "A": F.when(number, lpad(x, width, " ")).otherwise(rpad(x, width)),
    }
    return F.substring(forms[how], 1, width) if truncate else forms[how]


# --- numbers -------------------------------------------------------------------------

NUMERIC = r"^\s*[-+]?\d+(\.\d+)?([Ee][-+]?\d+)?\s*$"
#: Letters of the powers of the base (fixed values).
UNITS = ("", "K", "M", "G", "T", "P", "E", "Z", "Y")


def is_numeric(x: Column) -> Column:
    return x.rlike(NUMERIC)


def is_integer(x: Column) -> Column:
    return x.rlike(r"^\s*[-+]?\d+\s*$")


def human_scale(x: Column, base: int = 1024) -> tuple[Column, Column]:
    """The number in its unit, and the unit: 1,024 (or 1,000) already counts as 1 K."""
    value, unit = x.cast("double"), F.lit("")
    for k in range(1, len(UNITS)):
        over = F.abs(x) >= F.lit(float(base**k))
        value, unit = F.when(over, x / F.lit(float(base**k))).otherwise(value), F.when(over, F.lit(UNITS[k])).otherwise(unit)
    return value, unit


def to_human(x: Column, base: int = 1024) -> Column:
    value, unit = human_scale(x, base)
    return F.when(unit == "", F.format_string("%.0f", value)).otherwise(F.concat(F.format_string("%.2f", value), unit))


def from_human(x: Column, base: int = 1024) -> Column:
    number = F.expr("try_cast(null as double)")
    digits, unit = F.regexp_extract(x, r"^\s*([-+]?\d+(?:\.\d+)?)\s*([KMGTPEZY]?)", 1), F.regexp_extract(x, r"^\s*[-+]?\d+(?:\.\d+)?\s*([KMGTPEZY]?)", 1)
    factor = F.lit(1.0)
    for k in range(1, len(UNITS)):
        factor = F.when(unit == UNITS[k], F.lit(float(base**k))).otherwise(factor)
    return F.when(digits == "", number).otherwise(F.when(digits != "", digits).cast("double") * factor)


# --- lengths and code points ---------------------------------------------------------

ANSI = r"\x1b\[\d+(;\d+)*m"


def length_in_bytes(x: Column) -> Column:
    return F.octet_length(x)


def length_in_chars(x: Column) -> Column:
    return F.char_length(x)


def uncolored(x: Column) -> Column:
    return F.regexp_replace(x, ANSI, "")


def uncolored_length(x: Column) -> Column:
    return F.length(uncolored(x))


def utf8_bytes(code_point: Column, separator: str = "%") -> Column:
    """The UTF-8 bytes of a code point in hexadecimal, each behind the separator."""
    n = code_point.cast("long")
    low = lambda s: F.shiftright(n, s).bitwiseAND(F.lit(63)) + 128
    two = lambda v: F.lower(F.lpad(F.hex(v), 2, "0"))
    parts = (
        F.when(n < 0x80, F.array(two(n)))
        .when(n < 0x800, F.array(two(F.shiftright(n, 6) + 192), two(low(0))))
        .when(n < 0x10000, F.array(two(F.shiftright(n, 12) + 224), two(low(6)), two(low(0))))
        .otherwise(F.array(two(F.shiftright(n, 18) + 240), two(low(12)), two(low(6)), two(low(0))))
    )
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit(separator), p)), "")


def is_code_point(n: Column) -> Column:
    return (n >= 0) & (n <= 0x10FFFF) & ~n.isin(0xFFFE, 0xFFFF) & ~n.between(0x80, 0x9F)


# --- escaping ------------------------------------------------------------------------


def escape_regex(x: Column, more: str = "") -> Column:
    extra = "".join("\\" + c for c in more)
    return F.regexp_replace(x, rf"([().?*+\\\[\]{{}}^$|{extra}])", r"\\$1")


def drop_non_xml(x: Column) -> Column:
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def escape_xml_content(x: Column) -> Column:
    x = F.replace(F.replace(drop_non_xml(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(x, F.lit("]]>"), F.lit("]]&gt;"))


def escape_xml_attribute(x: Column) -> Column:
    x = F.replace(F.replace(drop_non_xml(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(x, F.lit('"'), F.lit("&quot;"))


def escape_xml_pi(x: Column) -> Column:
    return F.replace(drop_non_xml(x), F.lit("?>"), F.lit("?&gt;"))


def escape_xml_comment(x: Column) -> Column:
    return F.replace(drop_non_xml(x), F.lit("--"), F.lit("- -"))


def unescape_xml(x: Column) -> Column:
    """The five built-in names, &amp; last; ``udfs.unescape_entities`` knows all names and numbers."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def escape_json(x: Column) -> Column:
    """The inside of a JSON string."""
    quoted = F.to_json(F.struct(x.alias("v")))
    return F.substring(quoted, F.lit(7), F.greatest(F.length(quoted) - 8, F.lit(0)))


def indent_json(x: Column, schema: str) -> Column:
    return F.to_json(F.from_json(x, schema), {"pretty": "true"})


def backslashed(x: Column) -> Column:
    for char, name in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\x07", "\\a"), ("\x1b", "\\e"), ("\x00", "\\0")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def escape_uri(x: Column, plus: bool = False) -> Column:
    """Percent-encodes all but unreserved characters; a blank becomes %20, or + if asked for."""
    x = F.url_encode(x)  # form encoding: blank to +, and * left as it is
    x = F.replace(F.replace(x, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return x if plus else F.replace(x, F.lit("+"), F.lit("%20"))


def unescape_uri(x: Column, plus: bool = False) -> Column:
    """Percent-decodes; null where the escapes are no UTF-8. A + stays, or becomes a blank if asked for."""
    return F.try_url_decode(x if plus else F.replace(x, F.lit("+"), F.lit("%2B")))


def make_xml_name(x: Column) -> Column:
    x = F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}_:.-]", "_")
    return F.when(x.rlike(r"^[\p{L}_:]"), x).otherwise(F.concat(F.lit("_"), x))


def show_controls(x: Column) -> Column:
    """Controls and the blank as their Unicode pictures."""
    controls = "".join(chr(k) for k in range(33)) + "\x7f"
    return F.translate(x, controls, "".join(chr(0x2400 + k) for k in range(33)) + "␡")


# --- dates, paths, splits ------------------------------------------------------------


def iso_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss")


def iso_date(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def elapsed(start: Column, end: Column) -> Column:
    """hh:mm:ss between two epochs in seconds."""
    s = (end - start).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


PATH = r"^(.*/)?([^/]*?)(?:\.([^/.]*))?$"


def split_path(x: Column) -> Column:
    return F.struct(*[F.regexp_extract(x, PATH, k).alias(n) for k, n in ((1, "dir"), (2, "base"), (3, "ext"))])


def highest_suffix(names: Column, stem: str) -> Column:
    """Aggregate: the highest number n of names like stem_n, 0 if there is none."""
    n = F.regexp_extract(names, rf"^{stem}_?(\d+)(?:\.\w*)?$", 1)
    return F.coalesce(F.max(F.when(n != "", n).cast("int")), F.lit(0))


def split_escaped(x: Column, delimiter: str = ",", escape: str = "\\", unescape: bool = True, empties: bool = True) -> Column:
    """Splits on delimiters not behind an escape (an escaped escape does not count)."""
    e, d = "".join("\\" + c for c in escape), "".join(c if c.isalnum() else "\\" + c for c in delimiter)
    parts = F.split(x, rf"(?<=^|[^{e}]|(?<!{e})(?:{e}{e}){{1,50}}){d}")
    if unescape:
        parts = F.transform(parts, lambda p: F.regexp_replace(p, rf"{e}(.)", "$1"))
    return parts if empties else F.filter(parts, lambda p: p != "")


# --- terminal colours ----------------------------------------------------------------

#: Names that users type, in the order of their codes (fixed values).
COLORS = ("black", "red", "green", "yellow", "blue", "magenta", "cyan", "white", "default", "off")
#: The same of effects (fixed values).
EFFECTS = ("bold", "faint", "italic", "ul", "blink", "fblink", "inverse", "concealed", "strike", "plain")


def color_code(name: str) -> str:
    """The escape sequence of ``fg/bg/effect``; any part may be empty."""
    fg, bg, *effects = [*name.split("/"), "", ""][: max(2, name.count("/") + 1)]
    codes = ([str(30 + COLORS.index(fg))] if fg in COLORS[:8] else []) + ([str(40 + COLORS.index(bg))] if bg in COLORS[:8] else [])
    codes += [str(1 + EFFECTS.index(e)) for e in effects if e in EFFECTS[:9]]
    return f"\x1b[{';'.join(codes)}m" if codes else ""


def colorize(x: Column, name: str) -> Column:
    return F.concat(F.lit(color_code(name)), x, F.lit("\x1b[0m"))


def colorize_xml_tags(x: Column, name: str) -> Column:
    return F.regexp_replace(x, r"(<[^>]*>)", color_code(name).replace("\\", "\\\\") + "$1\x1b[0m")


def is_color_name(x: Column) -> Column:
    known = F.array(*[F.lit(c) for c in (*COLORS, *EFFECTS, "")])
    return x.isNotNull() & F.forall(F.split(x, "/"), lambda p: F.array_contains(known, p))


def nearest_cube_level(n: Column) -> Column:
    """The nearest of the six levels of the 6 x 6 x 6 colour cube, the lower of two."""
    levels = F.array(*[F.lit(v) for v in (0, 95, 135, 175, 215, 255)])
    return F.array_min(F.transform(levels, lambda v: F.struct(F.abs(v - n).alias("gap"), v.alias("level"))))["level"]
