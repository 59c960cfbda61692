"""Arrow-batched functions for what no SQL expression can state: decompositions, entity names, wrapping."""

from __future__ import annotations

import html
import re
import textwrap
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(f, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in x], dtype=object)

    return run


def decomposed(x: Column, form: str = "NFKD") -> Column:
    return _each(lambda v: unicodedata.normalize(form, v))(x)


def stripped_marks(x: Column) -> Column:
    """Compatibility decomposition without its combining marks; stays in SQL but for the decomposition."""
    return F.regexp_replace(decomposed(x), r"\p{M}+", "")


def unescape_entities(x: Column) -> Column:
    """Numeric references and all HTML names."""
    return _each(html.unescape)(x)


_ESCAPE = re.compile(r"\\(?:x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{1,2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([0-7]{1,3})|(.))", re.S)
_NAMED = {"a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _unescape(v: str) -> str:
    def one(m: re.Match) -> str:
        code = next((g for g in m.groups()[:4] if g), None)
        if code:
            return chr(int(code, 16)) if int(code, 16) < 0x110000 else m[0]
        return chr(int(m[5], 8)) if m[5] else _NAMED.get(m[6], m[6])

    return _ESCAPE.sub(one, v)


def unbackslashed(x: Column) -> Column:
    """Decodes backslash escapes by table; nothing is evaluated."""
    return _each(_unescape)(x)


def unescaped_percent(x: Column, mark: str = "%") -> Column:
    """Decodes hexadecimal escapes such as %41 behind any mark."""
    pattern = re.compile(re.escape(mark) + "([0-9A-Fa-f]{2})")
    return _each(lambda v: pattern.sub(lambda m: chr(int(m[1], 16)), v))(x)


def wrapped(x: Column, width: int = 79, indent: int = 0) -> Column:
    """Lines of at most ``width`` characters, all but the first behind the indent."""
    f = lambda v: "\n".join(textwrap.wrap(v, width, subsequent_indent=" " * indent, break_long_words=False, break_on_hyphens=False))
    return _each(f)(x)


def numeric_value(x: Column) -> Column:
    """The number each character stands for (½ is 0.5), null for texts that are no single such character."""
    return _each(lambda v: unicodedata.numeric(v, None) if len(v) == 1 else None, "double")(x)


def unified_values(x: Column, pattern: str) -> Column:
    r"""Characters of a category (\\p{Xx}) by the number they stand for."""
    category = pattern[3:-1]

    def one(c: str) -> str:
        if not unicodedata.category(c).startswith(category):
            return c
        value = unicodedata.numeric(c, None)
        return c if value is None else f"{value:g}"

    return _each(lambda v: "".join(map(one, v)))(x)


def character_name(x: Column) -> Column:
    return _each(lambda v: unicodedata.name(v, "") if len(v) == 1 else "")(x)


def ascii_references(x: Column) -> Column:
    """Every character beyond ASCII as a numeric character reference."""
    return _each(lambda v: re.sub(r"[^\x00-\x7f]", lambda m: f"&#x{ord(m[0]):X};", v))(x)


def escaped_xml_name(x: Column) -> Column:
    """Characters that a name cannot hold as -xxxx; the hyphen too, so that it can be undone."""
    return _each(lambda v: re.sub(r"[^\w.:]", lambda m: f"-{ord(m[0]):04x}", v))(x)


def unescaped_xml_name(x: Column) -> Column:
    return _each(lambda v: re.sub(r"-([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), v))(x)


def compiles(x: Column) -> Column:
    """Whether the text is a regular expression. Only texts with a character that can make one wrong are tried."""

    def ok(v: str) -> bool:
        try:
            re.compile(v)
        except re.error:
            return False
        return True

    tried = _each(ok, "boolean")(F.when(x.rlike(r"[\\\[()*+?{]"), x))
    return F.when(x.isNotNull(), F.coalesce(tried, F.lit(True)))


def indented_xml(x: Column, step: str = "  ") -> Column:
    """A break before each tag, indented by depth; text stays where it is."""

    def run(v: str) -> str:
        out, depth = [], 0
        for piece in re.split(r"(?=<)", v):
            if not piece:
                continue
            if piece.startswith("</"):
                depth = max(0, depth - 1)
            out.append("\n" + step * depth + piece if piece.startswith("<") else piece)
            if re.match(r"<[A-Za-z_:]", piece) and not re.match(r"<[^>]*/>", piece):
                depth += 1
        return "".join(out).lstrip("\n")

    return _each(run)(x)


def printable(x: Column, mode: str = "DFT", space: str = " ", line_feed: str = "\n") -> Column:
    """Controls in a visible form. DFT and SYM: Unicode pictures; C: backslash escapes; XML: references; LATIN1: all beyond ASCII as escapes too."""
    named = {"\a": "\\a", "\b": "\\b", "\x1b": "\\e", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}

    def one(c: str) -> str:
        k = ord(c)
        if c == " ":
            return space
        if c == "\n" and line_feed != "\n":
            return line_feed
        if 0x20 < k < 0x7F or (k >= 0xA0 and mode != "LATIN1"):
            return c
        if mode == "C":
            return named.get(c, f"\\x{k:02x}")
        if mode == "XML":
            return f"&#x{k:X};"
        if mode == "LATIN1":
            return named.get(c) or (f"\\x{k:02x}" if k < 0x100 else f"\\x{{{k:x}}}")
        return chr(0x2400 + k) if k < 0x20 else "␡" if k == 0x7F else f"\\x{k:02x}"

    return _each(lambda v: "".join(map(one, v)))(x)
