"""Balanced-delimiter scanning of whole texts, for syntaxes whose records are not lines.

The scan of a text is sequential, so a file is one task: give such sources as many files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=32)
def _signs(openers: str, closers: str, quotes: str, escape: str, comment: str) -> tuple[re.Pattern, re.Pattern]:
    """What matters inside a piece (comments, whole quoted strings, brackets), and outside (no quotes there)."""
    brackets = f"[{re.escape(openers + closers)}]"
    notes = [re.escape(comment) + r"[^\n]*+"] if comment else []
    e = re.escape(escape)
    strings = [rf"{q}(?:[^{q}{e}]|{e}.)*+(?:{q}|\Z|{e}\Z)" for q in map(re.escape, quotes)]
    return re.compile("|".join([*notes, *strings, brackets]), re.S), re.compile("|".join([*notes, brackets]), re.S)


def balanced(text: str, openers: str = "([{", closers: str = ")]}", quotes: str = "\"'", escape: str = "\\", comment: str = "") -> Iterator[str]:
    """Top-level balanced pieces of the text; what stands between them is passed over. The scan goes from sign to sign."""
    stack: list[str] = []
    pair = dict(zip(closers, openers, strict=True))
    inside, outside = _signs(openers, closers, quotes, escape, comment)
    start = k = 0
    while m := (inside if stack else outside).search(text, k):
        k, sign = m.end(), m[0]
        if len(sign) > 1:
            continue
        if sign in pair:
            if stack and stack[-1] == pair[sign]:
                stack.pop()
                if not stack:
                    yield text[start:k]
            else:
                stack.clear()
        elif sign in openers:
            if not stack:
                start = m.start()
            stack.append(sign)


def until_unquoted(text: str, delimiter: str, quotes: str = "\"'", escape: str = "\\") -> Iterator[str]:
    """Pieces between delimiters that stand outside quotes and brackets."""
    depth, start, k, quote = 0, 0, 0, ""
    while k < len(text):
        c = text[k]
        if quote:
            if c == escape:
                k += 1
            elif c == quote:
                quote = ""
        elif c in quotes:
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth <= 0 and text.startswith(delimiter, k):
            yield text[start:k]
            k += len(delimiter) - 1
            start = k + 1
        k += 1
    if text[start:].strip():
        yield text[start:]


def balanced_records(df: DataFrame, column: str = "value", **options) -> DataFrame:
    """(src, rec_no, value): the balanced pieces of each text, numbered within it. df needs a ``src`` column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (src, k, piece)
                for src, text in zip(batch["src"], batch["value"], strict=True)
                if isinstance(text, str)
                for k, piece in enumerate(balanced(text, **options), 1)
            ]
            yield pd.DataFrame(found, columns=["src", "rec_no", "value"])

    return df.select(F.col("src").cast("string").alias("src"), F.col(column).alias("value")).mapInPandas(run, "src string, rec_no long, value string")
