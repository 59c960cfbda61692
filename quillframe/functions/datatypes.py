"""Typed validation: a registry of datatypes, each compiled to a boolean or a normalised Column.

A type specification is ``NAME``, ``NAME(argument)`` and a repetition: ``!`` required,
``?`` optional (nil is fine), ``*`` any number of white-space separated parts, ``+`` one
or more. Checks are anchored. Values follow XML Schema 1.0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions import scalars, udfs

# Name classes of XML 1.0 (fixed values)
NAME_START = r":A-Z_a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}"
NAME_CHAR = NAME_START + r".\-0-9\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}"
NAME, NMTOKEN = f"[{NAME_START}][{NAME_CHAR}]*", f"[{NAME_CHAR}]+"
NCNAME = f"[{NAME_START.replace(':', '', 1)}][{NAME_CHAR.replace(':', '', 1)}]*"
XML_CHARS = r"[\x09\x0A\x0D\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]*"
_ZONE = r"(?:Z|[-+](?:0\d|1[0-4]):[0-5]\d)?"
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"-?(?:[1-9]\d{3,}|0\d{3})"
_TIME = r"(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?)"
_INT = r"[-+]?\d+"
_REAL = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"


@dataclass(frozen=True)
class Datatype:
    pattern: str
    low: int | None = None
    high: int | None = None
    numeric: bool = False
    collapse: bool = True
    of_schema: bool = True


def _integers() -> dict[str, Datatype]:
    out = {"integer": Datatype(_INT, numeric=True)}
    for name, bits in (("byte", 8), ("short", 16), ("int", 32), ("long", 64)):
        out[name] = Datatype(_INT, -(2 ** (bits - 1)), 2 ** (bits - 1) - 1, True)
        out["unsigned" + name.capitalize()] = Datatype(_INT, 0, 2**bits - 1, True)
    out |= {"nonNegativeInteger": Datatype(_INT, 0, None, True), "positiveInteger": Datatype(_INT, 1, None, True)}
    out |= {"nonPositiveInteger": Datatype(_INT, None, 0, True), "negativeInteger": Datatype(_INT, None, -1, True)}
    return out


_FLOAT = rf"(?:{_REAL}(?:[Ee][-+]?\d+)?|-?INF|NaN)"
TYPES: dict[str, Datatype] = {
    "boolean": Datatype("true|false|1|0"),
    "decimal": Datatype(_REAL, numeric=True),
    "double": Datatype(_FLOAT, numeric=True),
    "float": Datatype(_FLOAT, numeric=True),
    **_integers(),
    "date": Datatype(f"{_YEAR}-{_MONTH}-{_DAY}{_ZONE}"),
    "dateTime": Datatype(f"{_YEAR}-{_MONTH}-{_DAY}T{_TIME}{_ZONE}"),
    "time": Datatype(_TIME + _ZONE),
    "duration": Datatype(r"-?P(?=[\dT])(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?"),
    "gDay": Datatype(f"---{_DAY}{_ZONE}"),
    "gMonth": Datatype(f"--{_MONTH}{_ZONE}"),
    "gMonthDay": Datatype(f"--{_MONTH}-{_DAY}{_ZONE}"),
    "gYear": Datatype(_YEAR + _ZONE),
    "gYearMonth": Datatype(f"{_YEAR}-{_MONTH}{_ZONE}"),
    "language": Datatype("[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*"),
    "normalizedString": Datatype(r"[^\r\n\t]*"),
    "string": Datatype(r"(?s:.*)", collapse=False),
    "token": Datatype(r"(?:[^\s]+(?: [^\s]+)*)?"),
    "NMTOKEN": Datatype(NMTOKEN),
    "NMTOKENS": Datatype(rf"{NMTOKEN}(?:\s+{NMTOKEN})*"),
    "Name": Datatype(NAME),
    "NCName": Datatype(NCNAME),
    "ID": Datatype(NCNAME),
    "IDREF": Datatype(NCNAME),
    "IDREFS": Datatype(rf"{NCNAME}(?:\s+{NCNAME})*"),
    "ENTITY": Datatype(NCNAME),
    "ENTITIES": Datatype(rf"{NCNAME}(?:\s+{NCNAME})*"),
    "QName": Datatype(rf"(?:{NCNAME}:)?{NCNAME}"),
    "anyURI": Datatype(r"[^\s<>\"{}|\\^`]*"),
    "base64Binary": Datatype(r"(?:(?:[A-Za-z0-9+/]\s?){4})*(?:(?:[A-Za-z0-9+/]\s?){2}==|(?:[A-Za-z0-9+/]\s?){3}=)?"),
    "hexBinary": Datatype("(?:[0-9A-Fa-f]{2})*"),
    "ENUM": Datatype("", of_schema=False),
    "STRING": Datatype("", of_schema=False, collapse=False),
    "REGEX": Datatype("", of_schema=False, collapse=False),
    "ASCII": Datatype(r"[\x00-\x7F]*", of_schema=False, collapse=False),
    "BASEINT": Datatype(r"0[xX][0-9A-Fa-f]+|0[0-7]*|[1-9]\d*", of_schema=False),
}


@dataclass(frozen=True)
class TypeSpec:
    name: str
    argument: str = ""
    repetition: str = ""


def parse_spec(spec: str) -> TypeSpec:
    """``ENUM(a b)?`` and the like."""
    spec = spec.strip()
    repetition = spec[-1] if spec[-1:] in tuple("!?*+") else ""
    body = spec[: len(spec) - len(repetition)]
    name, _, rest = body.partition("(")
    if name not in TYPES or (rest and not rest.endswith(")")):
        raise ValueError(f"unknown datatype {spec!r}")
    return TypeSpec(name, rest[:-1] if rest else "", repetition)


def is_known(name: str) -> bool:
    return name in TYPES


def is_schema_type(name: str) -> bool:
    return name in TYPES and TYPES[name].of_schema


def is_numeric_type(name: str) -> bool:
    return name in TYPES and TYPES[name].numeric


def _one(spec: TypeSpec, x: Column) -> Column:
    kind = TYPES[spec.name]
    if spec.name == "ENUM":
        return x.isin(*spec.argument.split())
    if spec.name == "STRING":
        return x.rlike(f"^(?:{spec.argument})$") if spec.argument else x.isNotNull()
    if spec.name == "REGEX":
        return udfs.compiles(x)
    ok = x.rlike(rf"\A(?:{kind.pattern})\z")
    if spec.name == "ASCII" and spec.argument:
        ok = ok & x.rlike(rf"\A(?:{spec.argument})\z")
    if kind.low is not None or kind.high is not None:
        # digits beyond 38 are out of any bounded range and cast to null
        value = F.regexp_replace(x, r"^\+", "").try_cast("decimal(38,0)")
        for bound, test in ((kind.low, "__ge__"), (kind.high, "__le__")):
            if bound is not None:
                open_end = F.lit(bound).cast("decimal(38,0)") if abs(bound) < 2**63 else F.lit(str(bound)).cast("decimal(38,0)")
                huge = x.startswith("-") if test == "__le__" else ~x.startswith("-")
                ok = ok & F.coalesce(getattr(value, test)(open_end), huge)
    return ok


def conforms(x: Column, spec: str) -> Column:
    """Whether the value is of the type; nil is fine for ``?`` and ``*``, and wrong otherwise."""
    s = parse_spec(spec)
    nil = x.isNull() | (x == "")
    if s.repetition in ("*", "+"):
        parts = F.filter(F.split(x, r"\s+"), lambda p: p != "")
        good = F.forall(parts, lambda p: _one(TypeSpec(s.name, s.argument), p)) & (F.size(parts) > 0)
    else:
        good = _one(s, x)
    lenient = s.repetition in ("?", "*") or (s.repetition == "" and s.name in ("string", "STRING", "normalizedString", "token"))
    return F.coalesce(F.when(nil, F.lit(lenient)).otherwise(good), F.lit(False))


def normalized(x: Column, name: str) -> Column:
    """The value in the type's normal form, as text: integers in decimal, booleans 0 or 1, white space collapsed."""
    kind = TYPES[name]
    collapsed = scalars.normalize_space(x) if kind.collapse else x
    if name == "BASEINT":
        from_hex = F.conv(F.regexp_replace(collapsed, "^0[xX]", ""), 16, 10)
        from_oct = F.conv(collapsed, 8, 10)
        return F.when(collapsed.rlike("^0[xX]"), from_hex).when(collapsed.rlike("^0[0-7]+$"), from_oct).otherwise(collapsed)
    if name == "boolean":
        return F.when(collapsed.isin("", "0", "false"), F.lit("0")).otherwise(F.lit("1"))
    if kind.numeric and name not in ("decimal", "double", "float"):
        return F.coalesce(F.regexp_replace(collapsed, r"^\+", "").try_cast("decimal(38,0)").cast("string"), collapsed)
    if kind.numeric:
        return F.coalesce(collapsed.try_cast("double").cast("string"), collapsed)
    return collapsed


def sql_type(name: str) -> str:
    """The SQL type a column of this datatype is best cast to."""
    table = {
        "boolean": "boolean", "decimal": "decimal(38,18)", "double": "double", "float": "float", "byte": "tinyint", "short": "smallint", "int": "int",
        "long": "bigint", "integer": "decimal(38,0)", "unsignedByte": "smallint", "unsignedShort": "int", "unsignedInt": "bigint", "unsignedLong": "decimal(20,0)",
        "nonNegativeInteger": "decimal(38,0)", "positiveInteger": "decimal(38,0)", "nonPositiveInteger": "decimal(38,0)", "negativeInteger": "decimal(38,0)",
        "BASEINT": "bigint", "date": "date", "dateTime": "timestamp", "base64Binary": "binary", "hexBinary": "binary",
    }
    return table.get(name, "string")


def attribute_ok(x: Column, declared: str, required: bool = False, fixed: str | None = None) -> Column:
    """A DTD attribute definition: declared type, #REQUIRED, FIXED value."""
    list_type = declared in ("IDREFS", "NMTOKENS", "ENTITIES")
    ok = F.when(x.isNull(), F.lit(not required)).otherwise(F.lit(True) if declared == "CDATA" else conforms(x, declared + ("" if list_type else "!")))
    return ok & (F.coalesce(x == fixed, F.lit(True)) if fixed is not None else F.lit(True))


def is_xml_char_text(x: Column) -> Column:
    return x.rlike(rf"\A{XML_CHARS}\z")


def is_xml_space(x: Column) -> Column:
    return x.rlike(r"\A[\x20\t\r\n]+\z")


def is_xml_name(x: Column) -> Column:
    return x.rlike(rf"\A{NAME}\z")


def is_xml_nmtoken(x: Column) -> Column:
    return x.rlike(rf"\A{NMTOKEN}\z")
