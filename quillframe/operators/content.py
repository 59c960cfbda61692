"""Content models as automata over the children of elements, and which elements of a tree they admit.

A model (names, groups in order `,` or of choice `|` or of any order `&`, repetitions `?` `*`
`+`, EMPTY, ANY, #PCDATA) is compiled on the driver: its positions, which of them may come
first, last and after one another, and from these a table from (state, name) to state. The
table is as large as the document type, whatever the corpus. It is run over every parent's
children in one sweep of the tree, a state for each open element.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quillframe.operators import sweep

#: Members of a group of any order: all their orders are laid out.
MOST_ANY_ORDER = 5


@dataclass
class _Part:
    """Positions that may come first and last, whether nothing is enough."""

    first: frozenset[int]
    last: frozenset[int]
    empty: bool


@dataclass
class Model:
    """What an element may hold: states from 0, the names that lead on from each, and the states in which it may end."""

    steps: dict[tuple[int, str], int] = field(default_factory=dict)
    ends: frozenset[int] = frozenset({0})
    anything: bool = False
    inclusions: frozenset[str] = frozenset()
    exclusions: frozenset[str] = frozenset()
    end_omissible: bool = False

    def step(self, state: int, name: str) -> int | None:
        return state if self.anything else self.steps.get((state, name))


class _Parser:
    def __init__(self, text: str):
        self.tokens = re.findall(r"[A-Za-z_#:][\w.:-]*|[()|,&?*+]", text)
        self.at, self.names = 0, []
        self.after: dict[int, set[int]] = {}

    def _taken(self, wanted: str = "") -> str:
        token = self.tokens[self.at] if self.at < len(self.tokens) else ""
        if wanted and token not in wanted.split(" "):
            raise ValueError(f"{wanted!r} is missing in a content model")
        self.at += 1
        return token

    def _next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def part(self) -> _Part:
        if self._next() == "(":
            self._taken()
            # a group of any order is read once for each order
            start, kinds, members = self.at, "", [self.part()]
            while self._next() != ")":
                kind = self._taken(", | &")
                if kinds and kind != kinds:
                    raise ValueError("a group has one kind of connector")
                kinds = kind
                members.append(self.part())
            self._taken(")")
            out = self._any_order(start, len(members)) if kinds == "&" else self._row(members) if kinds != "|" else self._choice(members)
        elif (name := self._taken()) == "#PCDATA":
            out = _Part(frozenset(), frozenset(), True)  # texts are not judged
        elif re.match(r"[A-Za-z_:]", name):
            self.names.append(name)
            here = frozenset({len(self.names)})
            out = _Part(here, here, False)
        else:
            raise ValueError(f"{name!r} stands where a name or group should")
        if self._next() in ("?", "*", "+"):
            mark = self._taken()
            if mark != "?":
                self._follow(out.last, out.first)
            out = _Part(out.first, out.last, out.empty or mark != "+")
        return out

    def _follow(self, last: frozenset[int], first: frozenset[int]) -> None:
        for p in last:
            self.after.setdefault(p, set()).update(first)

    def _row(self, members: list[_Part]) -> _Part:
        out = members[0]
        for m in members[1:]:
            self._follow(out.last, m.first)
            out = _Part(out.first | m.first if out.empty else out.first, out.last | m.last if m.empty else m.last, out.empty and m.empty)
        return out

    def _choice(self, members: list[_Part]) -> _Part:
        return _Part(frozenset().union(*[m.first for m in members]), frozenset().union(*[m.last for m in members]), any(m.empty for m in members))

    def _any_order(self, start: int, n: int) -> _Part:
        if n > MOST_ANY_ORDER:
            raise ValueError(f"a group of any order has {n} members, more than {MOST_ANY_ORDER}")
        end, spans, at = self.at, [], start
        for _ in range(n):
            self.at = at
            self.part()
            spans.append(at)
            at = self.at + 1
        orders = []
        for order in itertools.permutations(spans):
            members = []
            for at in order:
                self.at = at
                members.append(self.part())
            orders.append(self._row(members))
        self.at = end
        return self._choice(orders)


def compiled(model: str, inclusions: str = "", exclusions: str = "", end_omissible: bool = False) -> Model:
    """The table of a content model; exceptions are names separated by spaces, bars or commas."""
    listed = lambda text: frozenset(re.findall(r"[A-Za-z_:][\w.:-]*", text))
    extra = {"inclusions": listed(inclusions), "exclusions": listed(exclusions), "end_omissible": end_omissible}
    if model.strip() in ("ANY", "EMPTY"):
        return Model(anything=model.strip() == "ANY", **extra)
    parser = _Parser(model)
    whole = parser.part()
    if parser._next():
        raise ValueError(f"{model!r} goes on behind its end")
    # sets of positions as states; the first is that before any child
    numbers: dict[frozenset[int], int] = {frozenset({0}): 0}
    after = {p: frozenset(s) for p, s in parser.after.items()} | {0: whole.first}
    steps, open_sets = {}, [frozenset({0})]
    while open_sets:
        state = open_sets.pop()
        reached: dict[str, set[int]] = {}
        for p in state:
            for q in after.get(p, ()):
                reached.setdefault(parser.names[q - 1], set()).add(q)
        for name, positions in reached.items():
            target = frozenset(positions)
            if target not in numbers:
                numbers[target] = len(numbers)
                open_sets.append(target)
            steps[numbers[state], name] = numbers[target]
    ends = frozenset(k for s, k in numbers.items() if s & whole.last or (whole.empty and 0 in s))
    return Model(steps, ends, **extra)


def models_of_dtd(dtd: str) -> dict[str, Model]:
    """Models of the element declarations of a document type: groups of names, omission marks, exceptions `-(...)` and `+(...)`."""
    out: dict[str, Model] = {}
    for names, marks, body in re.findall(r"<!ELEMENT\s+(\([^)]*\)|[^\s>]+)\s+(?:([-Oo]\s+[-Oo])\s+)?([^>]+?)\s*>", dtd):
        body = re.sub(r"--.*?--", " ", body, flags=re.S)
        incl = re.search(r"\s\+\(([^)]*)\)", body)
        excl = re.search(r"\s-\(([^)]*)\)", body)
        model = re.sub(r"\s[-+]\([^)]*\)", "", body).strip()
        for name in re.findall(r"[\w.:-]+", names):
            out.setdefault(name, compiled(model, incl[1] if incl else "", excl[1] if excl else "", marks.lower().endswith("o")))
    return out


#: What an element is where it starts (fixed values).
UNKNOWN, NOT_ADMITTED, BY_OMISSION, BY_INCLUSION, BY_MODEL = -2, -1, 0, 1, 2


class Admission:
    """(doc_id, pre, name, code, complete) of each element: how its parent admits it, and whether its own children end a model.

    An element without a parent, or in one that is not declared, is admitted by it as by an inclusion. One that its parent's
    model does not lead to may still come by an inclusion of any open element, unless an open element excludes it; or if
    the parent, and those around it as need be, may end there without a tag. Only admitted children move a model on.
    """

    COLUMNS = ("pre", "post", "depth", "kind", "name")
    SCHEMA = "doc_id long, pre int, name string, code int, complete boolean"

    def __init__(self, doc_id: int, models: dict[str, Model]):
        self.doc, self.models = doc_id, models
        self.open: list[list] = []  # [last, pre, name, model, state, code]

    def _code(self, name: str) -> int:
        if name not in self.models:
            return UNKNOWN
        above = self.open[-1] if self.open else None
        if above is None:
            return BY_INCLUSION
        model = above[3]
        if model is not None and (state := model.step(above[4], name)) is not None:
            above[4] = state
            return BY_MODEL
        included = excluded = False
        for frame in reversed(self.open):
            if frame[3] is None:
                return BY_INCLUSION
            included |= name in frame[3].inclusions
            excluded |= name in frame[3].exclusions
        if included and not excluded:
            return BY_INCLUSION
        for inner, outer in zip(reversed(self.open), reversed(self.open[:-1]), strict=False):
            if not (inner[3].end_omissible and (inner[3].anything or inner[4] in inner[3].ends)):
                break
            if (state := outer[3].step(outer[4], name)) is not None:
                outer[4] = state
                return BY_OMISSION
        return NOT_ADMITTED

    def node(self, row: tuple, out: list[tuple]) -> None:
        pre, post, depth, kind, name = row
        if kind != "element":
            return
        while self.open and self.open[-1][0] < pre:
            self._close(out)
        code = self._code(name)
        self.open.append([post + depth - 1, pre, name, self.models.get(name), 0, code])

    def _close(self, out: list[tuple]) -> None:
        _, pre, name, model, state, code = self.open.pop()
        out.append((self.doc, pre, name, code, None if model is None else model.anything or state in model.ends))

    def end(self, out: list[tuple]) -> None:
        while self.open:
            self._close(out)


def admission(nodes: DataFrame, models: dict[str, Model]) -> DataFrame:
    """How every element of the trees is admitted where it starts, and whether its content is complete where it ends (null: not declared)."""
    return sweep.swept(nodes.filter("kind = 'element'"), list(Admission.COLUMNS), lambda doc: Admission(doc, models), Admission.SCHEMA)
