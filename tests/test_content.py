"""Content models against regular expressions over the children, and admission on small trees."""

import itertools
import re

import pytest

from quillframe.operators import content, tree

MODELS = ["(a, b)", "(a | b)*", "(a, (b | c)+, a?)", "((a, b)*, c)", "(a?, b?, c?)", "(a & b & c)", "(a & (b, c)?)", "(#PCDATA | a)*", "((a | b), (a | c))", "EMPTY", "((a, b) | (a, c))", "(a+, a)"]


def as_pattern(model):
    """The model as a pattern over letters; groups of any order by their permutations."""
    if model == "EMPTY":
        return ""
    text = model.replace("#PCDATA", "").replace(" ", "").replace(",", "")
    for group, members in (("(a&b&c)", "abc"), ("(a&(bc)?)", None)):
        orders = ["".join(p) for p in itertools.permutations(members)] if members else ["a(bc)?", "(bc)?a"]
        text = text.replace(group, "(" + "|".join(orders) + ")")
    return text


@pytest.mark.parametrize("model", MODELS)
def test_automata_against_patterns(model):
    compiled, pattern = content.compiled(model), re.compile(as_pattern(model))
    for n in range(5):
        for word in itertools.product("abc", repeat=n):
            state = 0
            for name in word:
                state = compiled.step(state, name) if state is not None else None
            assert (state is not None and state in compiled.ends) == bool(pattern.fullmatch("".join(word))), word


@pytest.mark.parametrize("model", ["(a, b | c)", "(a", "(a,,b)", "a)", "(a & b & c & d & e & f)"])
def test_bad_models_are_refused(model):
    with pytest.raises(ValueError):
        content.compiled(model)


DTD = """
<!ELEMENT doc - - (head, (par | list)*, note?) +(mark)>
<!ELEMENT head - - (#PCDATA)>
<!ELEMENT par - O (#PCDATA | emph)* -(mark)>
<!ELEMENT (list) - - (item, item+)>
<!ELEMENT item - O (#PCDATA)>
<!ELEMENT (emph | note | mark) - - (#PCDATA)>
"""


def codes(spark, page):
    nodes = tree.shred(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html")
    rows = content.admission(nodes, content.models_of_dtd(DTD)).orderBy("pre").collect()
    return [(r["name"], r["code"], r["complete"]) for r in rows]


def test_codes(spark):
    assert codes(spark, "<doc><head>x</head><par>y<emph>z</emph></par><list><item>1</item></list></doc>") == [
        ("doc", 1, True), ("head", 2, True), ("par", 2, True), ("emph", 2, True), ("list", 2, False), ("item", 2, True),
    ]
    # by inclusion anywhere in doc, but excluded in par
    assert codes(spark, "<doc><mark></mark><head></head><par><mark></mark></par></doc>")[1:] == [("mark", 1, True), ("head", 2, True), ("par", 2, True), ("mark", -1, True)]
    # a note in a paragraph: the paragraph could have ended there; nothing may follow the note
    assert codes(spark, "<doc><head></head><par>a<note></note></par><par></par></doc>")[3:] == [("note", 0, True), ("par", -1, True)]
    # the wrong order, an unknown element, and what is in it
    assert codes(spark, "<doc><par></par><zzz><par></par></zzz></doc>") == [("doc", 1, False), ("par", -1, True), ("zzz", -2, None), ("par", 1, True)]


def test_documents_are_apart(spark):
    rows = [(k, "<doc><head></head></doc>" if k % 2 else "<doc><par></par></doc>") for k in range(40)] + [(99, None), (98, "")]
    nodes = tree.shred(spark.createDataFrame(rows, "id long, html string").repartition(5), "id", "html")
    got = content.admission(nodes, content.models_of_dtd(DTD)).filter("pre = 0").collect()
    assert {r["doc_id"]: r["complete"] for r in got} == {k: bool(k % 2) for k in range(40)}
