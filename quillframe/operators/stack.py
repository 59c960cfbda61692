"""What is open at each event of a markup stream, for documents of any size.

An event table has (doc_id, ord, event, name): ``start`` and ``end`` of elements, and any
other event as a node of its own. What a stretch of events does to the stack is told by few
things: how many open elements it closes, how many nodes it puts under each as it comes to
it, and which it leaves open. Stretches are put together in order (a monoid), so a document
is cut into ranges of ``ord``, each is summed up by itself, the sums of a document are run
through in order, and each range is gone through again from the stack it begins with. No
task holds more than a range and a stack.

Defined cases: an end event closes what is innermost, whatever its name (``ok`` tells whether
it was meant); an end where nothing is open closes nothing; a document may end with elements
open; events of one ``ord`` go in order of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.operators import sweep

#: Events of a range, by their numbers.
RANGE = 100_000
_SUM = "doc_id long, range long, closes int, opens array<string>, counts array<int>, under array<int>"
_STACK = "doc_id long, range long, names array<string>, counts array<int>"
EVENTS = "doc_id long, ord long, event string, name string, depth int, path string, pointer string, n_open int, innermost int, outermost int, ok boolean"


class _Sum:
    """A range's effect: closes, what it leaves open with their numbers of nodes, and nodes put under what is innermost after each close."""

    COLUMNS = ("event", "name")

    def __init__(self, doc_id: int, part: int):
        self.key, self.under, self.open = (doc_id, part), [0], []

    def node(self, row: tuple, out: list[tuple]) -> None:
        event, name = row
        if event == "end":
            if self.open:
                self.open.pop()
            else:
                self.under.append(0)
            return
        if self.open:
            self.open[-1][1] += 1
        else:
            self.under[-1] += 1
        if event == "start":
            self.open.append([name, 0])

    def end(self, out: list[tuple]) -> None:
        out.append((*self.key, len(self.under) - 1, [n for n, _ in self.open], [k for _, k in self.open], self.under))


class _Before:
    """The stack before each range of a document; the first entry stands for the document itself."""

    COLUMNS = ("range", "closes", "opens", "counts", "under")

    def __init__(self, doc_id: int):
        self.doc, self.stack = doc_id, [("", 0)]

    def node(self, row: tuple, out: list[tuple]) -> None:
        part, closes, opens, counts, under = row
        out.append((self.doc, part, [n for n, _ in self.stack], [k for _, k in self.stack]))
        # what closes nothing leaves its nodes where they are, under the document
        closes = min(closes, len(self.stack) - 1)
        kept = self.stack[: len(self.stack) - closes]
        kept[-1] = (kept[-1][0], kept[-1][1] + sum(int(k) for k in under[closes:]))
        self.stack = kept + list(zip(opens, counts, strict=True))

    def end(self, out: list[tuple]) -> None:
        pass


class _Open:
    """Each event with what is open at it, from the stack that stands first in its range."""

    COLUMNS = ("ord", "event", "name", "names", "counts")

    def __init__(self, doc_id: int, part: int, asked: frozenset[str]):
        self.doc, self.asked, self.names, self.counts, self.places = doc_id, asked, [], [0], [0]

    def node(self, row: tuple, out: list[tuple]) -> None:
        place, event, name, names, counts = row
        if event == "":
            self.names, self.counts = list(names)[1:], [int(k) for k in counts]
            return
        ok = None
        if event == "end":
            ok = bool(self.names) and self.names[-1] == name
        else:
            self.counts[-1] += 1
        shown = [*self.names, name] if event != "end" else self.names
        numbers = self.counts if event != "end" else self.counts[:-1]
        found = [k for k, n in enumerate(shown, 1) if n in self.asked]
        out.append((self.doc, place, event, name, len(shown), "/".join(shown), "/".join(map(str, numbers)), len(found), found[-1] if found else -1, found[0] if found else -1, ok))
        if event == "start":
            self.names.append(name)
            self.counts.append(0)
        elif event == "end" and self.names:
            self.names.pop()
            self.counts.pop()

    def end(self, out: list[tuple]) -> None:
        pass


def opened(events: DataFrame, names: list[str] | None = None, size: int = RANGE) -> DataFrame:
    """Each event with depth, path, pointer (child numbers) of its node, and of the ``names``: how many are open, the innermost and outermost (levels from 1; -1: none).

    A node counts as open at its own start and end; ``ok`` is there for ends.
    """
    rows = events.select("doc_id", F.col("ord").cast("long").alias("ord"), "event", "name").withColumn("range", F.floor(F.col("ord") / size))
    sums = sweep.swept(rows, list(_Sum.COLUMNS), _Sum, _SUM, ["ord", "name"], ("doc_id", "range"))
    stacks = sweep.swept(sums, list(_Before.COLUMNS), _Before, _STACK, ["range"])
    # each range's stack goes before its events
    first = stacks.select("doc_id", F.lit(-1).cast("long").alias("ord"), F.lit("").alias("event"), F.lit("").alias("name"), "range", "names", "counts")
    asked = frozenset(names or ())
    return sweep.swept(rows.unionByName(first, allowMissingColumns=True), list(_Open.COLUMNS), lambda d, r: _Open(d, r, asked), EVENTS, ["ord", "name"], ("doc_id", "range"))


def events_of(nodes: DataFrame) -> DataFrame:
    """The event table of node tables: starts and ends of elements, other nodes by their kinds. Places follow from the nodes' numbers."""
    start, end = 2 * F.col("pre") - F.col("depth") + 1, 2 * F.col("post") + F.col("depth")
    starts = nodes.select("doc_id", start.cast("long").alias("ord"), F.when(F.col("kind") == "element", "start").otherwise(F.col("kind")).alias("event"), "name")
    return starts.unionByName(nodes.filter("kind = 'element'").select("doc_id", end.cast("long").alias("ord"), F.lit("end").alias("event"), "name"))
