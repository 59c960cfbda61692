"""Entities of documents that bring their own definitions: each row has a declaration subset and a text that refers to it.

Rows are independent, so all runs in tasks, a row at a time. Declarations are read in order
(the first of a name binds), parameter entities where they stand, between declarations or in
values, and the general entities that a text needs are flattened in the order of their
references, each once. A name that leads back to itself, goes too deep or grows too large is
left as it is and reported, so no document can make a task run over.

Codes: CYCLE, TOODEEP, TOOLARGE, UNDEFINED (a general entity), UNDEFINED% (a parameter entity).
Defined cases: a null subset defines nothing, a null text stays null and reports what is
wrong with the subset alone; character references and the five names of XML are always
known; external entities are not fetched, their names are UNDEFINED.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How deep definitions may lead into one another, and how long the text of one may become.
DEEPEST, LARGEST = 32, 1_000_000
#: Names that need no definition (fixed values).
PREDEFINED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
RESULT = "doc_id long, expanded string, depth int, errors array<struct<code:string,name:string>>"

_NAME = r"[A-Za-z_:][\w:.-]*"
_DECLARED = re.compile(rf"<!--.*?-->|<\?.*?\?>|<!ENTITY\s+(%\s+)?({_NAME})\s+(?:\"([^\"]*)\"|'([^']*)'|[^>]*)\s*>|<![^>\[]*>|%({_NAME});", re.S)
_REFERENCE = re.compile(rf"&(#[0-9]+|#[xX][0-9A-Fa-f]+|{_NAME});")


def _character(reference: str) -> str | None:
    point = int(reference[2:], 16) if reference[1] in "xX" else int(reference[1:])
    return chr(point) if 0 < point < 0x110000 and not 0xD800 <= point < 0xE000 else None


class Subset:
    """The definitions of one document."""

    def __init__(self, text: str, default: str | None = None):
        self.general: dict[str, str] = {}
        self.parameter: dict[str, str] = {}
        self.default, self.depth = default, 0
        self.flat: dict[str, tuple[str | None, int]] = {}  # text (None: left as it is) and depth
        self.errors: dict[tuple[str, str], None] = {}  # in order of appearance
        self._read(text, ())

    def _report(self, code: str, name: str) -> None:
        self.errors.setdefault((code, name))

    def _entered(self, name: str, within: tuple[str, ...]) -> str | None:
        """The text of a parameter entity, or None with a report."""
        code = "CYCLE" if name in within else "TOODEEP" if len(within) >= DEEPEST else "UNDEFINED%" if name not in self.parameter else None
        if code:
            self._report(code, name)
            return None
        return self.parameter[name]

    def _read(self, text: str, within: tuple[str, ...]) -> None:
        for m in _DECLARED.finditer(text):
            if m[5]:
                inner = self._entered(m[5], within)
                if inner is not None:
                    self._read(inner, (*within, m[5]))
            elif m[2] and (m[3] is not None or m[4] is not None):
                value = self._value(m[3] if m[3] is not None else m[4], within)
                (self.parameter if m[1] else self.general).setdefault(m[2], value)

    def _value(self, value: str, within: tuple[str, ...]) -> str:
        """A value as it is kept: parameter entities and character references in it are replaced, general ones wait."""

        def parameter(m: re.Match) -> str:
            inner = self._entered(m[1], within)
            return m[0] if inner is None else inner

        value = re.sub(rf"%({_NAME});", parameter, value)
        if len(value) > LARGEST:
            self._report("TOOLARGE", "%")
            return ""
        return re.sub(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+);", lambda m: m[0] if m[1] in ("#38", "#60") else _character(m[1]) or m[0], value)

    def _flatten(self, text: str) -> None:
        """Texts of all general entities that a text leads to, each after those it refers to itself."""
        refers, waiting = {}, [text]
        while waiting:
            for m in _REFERENCE.finditer(waiting.pop()):
                if m[1] in self.general and m[1] not in refers:
                    refers[m[1]] = {r[1] for r in _REFERENCE.finditer(self.general[m[1]]) if r[1] in self.general}
                    waiting.append(self.general[m[1]])
        users: dict[str, set[str]] = {n: set() for n in refers}
        for n, others in refers.items():
            for other in others:
                users[other].add(n)
        left = {n: len(others) for n, others in refers.items()}
        ready = [n for n in self.general if left.get(n) == 0]
        for n in ready:
            self._settle(n, refers[n])
            for user in users[n]:
                left[user] -= 1
                if not left[user]:
                    ready.append(user)
        # what was never ready leads into a circle; what is in one is also led to from one
        stuck = [n for n in self.general if left.get(n)]
        circles = set(stuck)
        while outer := {n for n in circles if not users[n] & circles}:
            circles -= outer
        for n in stuck:
            self.flat[n] = None, 0
            if n in circles:
                self._report("CYCLE", n)

    def _settle(self, name: str, refers: set[str]) -> None:
        depth = 1 + max((self.flat[r][1] for r in refers), default=0)
        if any(self.flat[r][0] is None for r in refers):
            self.flat[name] = None, depth
            return
        size = len(self.general[name]) + sum(len(self.flat[m[1]][0]) for m in _REFERENCE.finditer(self.general[name]) if m[1] in self.flat)
        code = "TOODEEP" if depth > DEEPEST else "TOOLARGE" if size > LARGEST else None
        if code:
            self._report(code, name)
        self.flat[name] = (None if code else self._replaced(self.general[name]), depth)

    def _replaced(self, text: str) -> str:
        def piece(m: re.Match) -> str:
            name = m[1]
            if name.startswith("#"):
                return _character(name) or m[0]
            if name in self.general:
                flat = self.flat[name][0]
                return m[0] if flat is None else flat
            if name in PREDEFINED:
                return PREDEFINED[name]
            self._report("UNDEFINED", name)
            return m[0] if self.default is None else self.default

        return _REFERENCE.sub(piece, text)

    def expanded(self, text: str) -> str:
        self._flatten(text)
        self.depth = max((self.flat[m[1]][1] for m in _REFERENCE.finditer(text) if m[1] in self.flat), default=0)
        return self._replaced(text)


def expanded_documents(docs: DataFrame, subset: str, text: str, default: str | None = None) -> DataFrame:
    """(doc_id, expanded, depth, errors): each text by its own subset; unknown names become the default, or stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, own, body in zip(batch["doc_id"], batch["subset"], batch["body"], strict=True):
                entities = Subset(own if isinstance(own, str) else "", default)
                out = entities.expanded(body) if isinstance(body, str) else None
                rows.append((key, out, entities.depth, [{"code": c, "name": n} for c, n in entities.errors]))
            yield pd.DataFrame(rows, columns=["doc_id", "expanded", "depth", "errors"])

    return docs.select("doc_id", F.col(subset).alias("subset"), F.col(text).alias("body")).mapInPandas(run, RESULT)
