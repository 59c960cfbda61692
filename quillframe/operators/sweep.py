"""Node tables swept in document order: one pass with a stack of what is open, in place of joins between ancestors and descendants.

Rows are dealt by document, sorted, and streamed; a task holds the open elements of one
document and what waits for an answer, never the document. A node's last descendant is known
from its numbers (``post + depth - 1``), so a sweep needs no end events. Work is linear in
the nodes, whatever the depth.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an output batch.
BATCH = 20_000


class Sweep(Protocol):
    """State over one document. Both methods may add rows to ``out``."""

    def node(self, row: tuple, out: list[tuple]) -> None: ...

    def end(self, out: list[tuple]) -> None: ...


def swept(rows: DataFrame, columns: list[str], start: Callable[..., Sweep], schema: str, order: list[str] | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of ``schema`` from ``start(key, ...)``, which is given the columns of each node of its document (or part of one) in order."""
    order = order or ["pre"]
    names = [f.split()[0] for f in schema.split(", ")]
    ints = [f.split()[0] for f in schema.split(", ") if f.split()[1] in ("int", "long")]

    def frame(out: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(out, columns=names)
        return table.astype({c: "Int64" for c in ints})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, sweep, out = None, None, []
        for batch in batches:
            for key, *row in zip(zip(*[batch[k].tolist() for k in keys], strict=True), *[_values(batch[c]) for c in columns], strict=True):
                if sweep is None or key != doc:
                    if sweep is not None:
                        sweep.end(out)
                    doc, sweep = key, start(*key)
                sweep.node(tuple(row), out)
                if len(out) >= BATCH:
                    yield frame(out)
                    out = []
        if sweep is not None:
            sweep.end(out)
        if out:
            yield frame(out)

    sent = rows.select(*keys, *dict.fromkeys(c for c in [*columns, *order] if c not in keys))
    return sent.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _values(column: pd.Series) -> list:
    """Python values, missing numbers as None."""
    if column.dtype == object:
        return column.tolist()
    return column.astype(object).where(column.notna(), None).tolist()


class Axis:
    """The n-th match on an axis for each context node, as (doc_id, from_pre, pre). Nearest first."""

    COLUMNS = ("pre", "post", "depth", "parent", "_context", "_match")
    SCHEMA = "doc_id long, from_pre int, pre int"

    def __init__(self, doc_id: int, axis: str, n: int):
        self.doc, self.axis, self.n = doc_id, axis, n
        self.open: list[tuple[int, int]] = []  # (pre, last) of the open nodes that match
        self.matches: list[int] = []
        self.last_of: dict[int, int] = {}  # of the matches, for the preceding axis
        self.children: dict[Any, list[int]] = defaultdict(list)  # matches by parent
        self.waiting: dict[Any, list[tuple[int, int]]] = defaultdict(list)  # (context, last) by what answers it
        self.ends: list[tuple[int, int]] = []  # (first place behind it, context)

    def node(self, row: tuple, out: list[tuple]) -> None:
        pre, post, depth, parent, context, match = row
        last, axis, n = post + depth - 1, self.axis, self.n
        while self.open and self.open[-1][1] < pre:
            self.open.pop()
        while self.ends and self.ends[0][0] <= pre:
            self.waiting[len(self.matches) + n].append((heapq.heappop(self.ends)[1], 1 << 62))
        if context:
            found = None
            if axis == "ancestor":
                found = self.open[-n][0] if len(self.open) >= n else None
            elif axis == "preceding-sibling":
                before = self.children.get(parent, ())
                found = before[-n] if len(before) >= n else None
            elif axis == "preceding":
                found = self._closed(pre)
            elif axis == "descendant":
                self.waiting[len(self.matches) + bool(match) + n].append((pre, last))
            elif axis == "following":
                heapq.heappush(self.ends, (last + 1, pre))
            elif axis == "following-sibling":
                self.waiting[parent, len(self.children.get(parent, ())) + bool(match) + n].append((pre, 1 << 62))
            elif axis == "child":
                self.waiting[pre, n].append((pre, 1 << 62))
            if found is not None:
                out.append((self.doc, pre, found))
        if match:
            self.matches.append(pre)
            key: Any = len(self.matches)
            if axis in ("child", "following-sibling", "preceding-sibling"):
                own = self.children[parent]
                own.append(pre)
                key = (parent, len(own))
            for at, until in self.waiting.pop(key, ()):
                if pre <= until:
                    out.append((self.doc, at, pre))
            if axis == "ancestor":
                self.open.append((pre, last))
            if axis == "preceding":
                self.last_of[pre] = last

    def _closed(self, pre: int) -> int | None:
        """The n-th match before a place that has ended there: of those passed over, as many as are open, ancestors."""
        left = self.n
        for k in range(len(self.matches) - 1, -1, -1):
            if self.last_of[self.matches[k]] < pre:
                left -= 1
                if not left:
                    return self.matches[k]
        return None

    def end(self, out: list[tuple]) -> None:
        pass


class Inherited:
    """The value of the nearest ancestor-or-self that has one, as (doc_id, pre, value)."""

    COLUMNS = ("pre", "post", "depth", "_value")

    def __init__(self, doc_id: int):
        self.doc, self.open = doc_id, []

    def node(self, row: tuple, out: list[tuple]) -> None:
        pre, post, depth, value = row
        while self.open and self.open[-1][0] < pre:
            self.open.pop()
        if value is not None:
            self.open.append((post + depth - 1, value))
        if self.open:
            out.append((self.doc, pre, self.open[-1][1]))

    def end(self, out: list[tuple]) -> None:
        pass


class Kept:
    """The places of the nodes that stay when some elements go but not what is in them: the numbers of the kept ancestors and their own."""

    COLUMNS = ("pre", "post", "depth", "_gone")
    SCHEMA = "doc_id long, pre int, _at array<double>"

    def __init__(self, doc_id: int):
        self.doc, self.open = doc_id, []

    def node(self, row: tuple, out: list[tuple]) -> None:
        pre, post, depth, gone = row
        while self.open and self.open[-1][0] < pre:
            self.open.pop()
        if not gone:
            out.append((self.doc, pre, [float(p) for _, p in self.open] + [float(pre)]))
            self.open.append((post + depth - 1, pre))

    def end(self, out: list[tuple]) -> None:
        pass


class Numbers:
    """All numbers, paths and languages of nodes that come in order of their places; a node leaves when all in it has left."""

    COLUMNS = ("kind", "name", "attrs", "text", "_at")

    def __init__(self, doc_id: int):
        self.doc, self.pre, self.post = doc_id, 0, 0
        self.open: list[list] = []  # [place, number, children, path, pointer, language, node]
        self.roots = 0

    def node(self, row: tuple, out: list[tuple]) -> None:
        kind, name, attrs, text, at = row
        at, attrs = tuple(at), dict(attrs) if attrs is not None else {}
        while self.open and at[: len(self.open[-1][0])] != self.open[-1][0]:
            self._close(out)
        above = self.open[-1] if self.open else None
        if above:
            above[2] += 1
            number = above[2]
        else:
            self.roots += 1
            number = self.roots
        path = f"{above[3]}/{name}" if above else name
        pointer = f"{above[4]}/{number}" if above else str(number)
        language = attrs.get("lang") or attrs.get("xml:lang") or (above[5] if above else None)
        node = (self.pre, above[1] if above else None, len(self.open) + 1, number, kind, name, attrs, text, path, pointer, language)
        self.open.append([at, self.pre, 0, path, pointer, language, node])
        self.pre += 1

    def _close(self, out: list[tuple]) -> None:
        node = self.open.pop()[6]
        out.append((self.doc, node[0], self.post, *node[1:]))
        self.post += 1

    def end(self, out: list[tuple]) -> None:
        while self.open:
            self._close(out)


def flagged(nodes: DataFrame, **flags: Any) -> DataFrame:
    """Columns of the conditions, false where they are null."""
    return nodes.withColumns({name: F.coalesce(test, F.lit(False)) for name, test in flags.items()})
