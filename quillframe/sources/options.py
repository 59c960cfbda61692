"""Format options: one typed registry for all syntaxes, checked when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

FORMATS = ("arff", "columns", "csv", "json", "manchester", "mime", "perl", "sexp", "xml", "xsv")
#: Other names that options are known by.
ALIASES = {"delim": "field_sep", "sep": "field_sep", "encoding": "charset", "sub_field_sep": "sub_sep"}


@dataclass(frozen=True)
class Option:
    default: Any
    kind: type
    help: str


OPTIONS: dict[str, Option] = {
    "header": Option(True, bool, "the first record names the fields"),
    "charset": Option("UTF-8", str, "encoding of the source"),
    "field_sep": Option(",", str, "between fields, taken literally"),
    "quote": Option('"', str, "around fields"),
    "escape": Option("", str, "before special characters; empty: quotes are doubled"),
    "qdouble": Option(True, bool, "a doubled quote stands for one"),
    "nl_in_quotes": Option(True, bool, "records may go over lines"),
    "strip_fields": Option(True, bool, "white space off both ends of fields"),
    "strip_records": Option(False, bool, "white space off both ends of records"),
    "comment": Option("", str, "records that start with this are skipped"),
    "field_names": Option(None, list, "names, where there is no header"),
    "one_document": Option(False, bool, "the files of a folder, in order of their names, are one document"),
    "positions": Option(None, list, "start columns, from 0"),
    "default": Option(None, str, "for missing values without a default of their own"),
    "line_length": Option(78, int, "longest line of folded headers"),
    "quoted_printable": Option(False, bool, "encode what is not printable ASCII"),
    "ascii_only": Option(False, bool, "characters beyond ASCII as references or escapes"),
    "tr_tag": Option("tr", str, "element of a record"),
    "td_tag": Option("td", str, "element of a field"),
    "table_tag": Option("table", str, "element of a table"),
    "class_attr": Option("class", str, "attribute that names a field"),
    "attr_fields": Option(None, list, "attributes of the record that become fields"),
    "id_attr": Option("", str, "record attribute with the record number or id field"),
    "rec_name": Option("Rec", str, "element of a typed tuple"),
    "head_name": Option("Head", str, "element of its declarations"),
    "xsv_name": Option("Xsv", str, "element around typed tuples"),
    "type_check": Option(True, bool, "check declared types"),
    "omit_defaults": Option(False, bool, "leave out values that equal their defaults"),
    "relation": Option("relation", str, "name of the relation"),
    "var_name": Option("foo", str, "name of the variable"),
    "sub_sep": Option(" ", str, "between sub-fields"),
    "nil": Option("", str, "written for missing values"),
}


def unbackslash(value: str) -> str:
    """Escapes in option values, such as a tab written as backslash t."""
    for name, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\\\", "\\")):
        value = value.replace(name, char)
    return value


def resolve(**given: Any) -> dict[str, Any]:
    """All options, checked; unknown names and values of the wrong type are refused."""
    out = {k: o.default for k, o in OPTIONS.items()}
    for name, value in given.items():
        name = ALIASES.get(name, name)
        if name not in OPTIONS:
            raise ValueError(f"unknown option {name!r}")
        option = OPTIONS[name]
        if value is not None and not isinstance(value, option.kind):
            raise TypeError(f"{name} takes {option.kind.__name__}, not {value!r}")
        out[name] = unbackslash(value) if isinstance(value, str) else value
    if out["escape"] and len(out["escape"]) != 1 or len(out["quote"]) > 1:
        raise ValueError("quote and escape are single characters")
    return out


def helps() -> dict[str, str]:
    return {k: o.help for k, o in OPTIONS.items()}


#: Option names of the common CSV libraries and what they are here.
CSV_NAMES = {
    "sep_char": "sep", "quote_char": "quote", "escape_char": "escape", "comment_str": "comment", "undef_str": "nullValue", "empty_is_undef": "emptyValue",
    "always_quote": "quoteAll", "eol": "lineSep", "allow_whitespace": "ignoreLeadingWhiteSpace", "strict": "mode", "binary": "multiLine",
}


def csv_reader_options(**native: Any) -> dict[str, str]:
    """Options named as in the common CSV libraries to those of the built-in reader."""
    out: dict[str, str] = {}
    for name, value in native.items():
        target = CSV_NAMES[name]
        if name == "strict":
            out[target] = "FAILFAST" if value else "PERMISSIVE"
        elif name == "allow_whitespace":
            out |= {"ignoreLeadingWhiteSpace": str(bool(value)).lower(), "ignoreTrailingWhiteSpace": str(bool(value)).lower()}
        else:
            out[target] = str(value).lower() if isinstance(value, bool) else str(value)
    return out
