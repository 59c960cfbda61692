"""Documents with their own entity definitions."""

from quillframe.operators import entities


def one(subset, text, **more):
    e = entities.Subset(subset, **more)
    return e.expanded(text), e.depth, list(e.errors)


def test_general_and_parameter_entities():
    subset = """<!-- <!ENTITY a "no"> --><!ENTITY a "1"><!ENTITY a "2"><!ENTITY b '&a;&#38;&#65;'>
      <!ENTITY % more "<!ENTITY c '&b;!'> <!ELEMENT x (y)>"> %more; <!ENTITY % w "world"> <!ENTITY d "hello %w; &undefined;">"""
    assert one(subset, "x &a; &b; &c; &d; &#x42; &lt;") == ("x 1 1&A 1&A! hello world &undefined; B <", 3, [("UNDEFINED", "undefined")])
    assert one(subset, "&nothing;", default="?") == ("?", 0, [("UNDEFINED", "nothing")])


def test_circles_are_reported_and_left():
    subset = '<!ENTITY a "1&b;"><!ENTITY b "2&c;"><!ENTITY c "3&a;"><!ENTITY ok "fine"><!ENTITY self "&self;">'
    out, _, errors = one(subset, "&ok; &a; &self; &ok;")
    assert out == "fine &a; &self; fine" and errors == [("CYCLE", n) for n in ("a", "b", "c", "self")]
    # what leads into a circle from outside is left as a whole, but is not in it
    assert one(subset + '<!ENTITY out "see &b;">', "&out;")[::2] == ("&out;", [("CYCLE", n) for n in "abc"])
    out, _, errors = one('<!ENTITY % p "%q;"><!ENTITY % q "%p;">%p;<!ENTITY z "%zz;">', "&z;")
    assert out == "%zz;" and ("UNDEFINED%", "zz") in errors


def test_growth_and_depth_have_bounds():
    laughs = '<!ENTITY l0 "ha">' + "".join(f'<!ENTITY l{k} "{f"&l{k - 1};" * 10}">' for k in range(1, 12))
    out, _, errors = one(laughs, "a &l11; &l2;")
    assert out == "a &l11; " + "ha" * 100 and ("TOOLARGE", "l6") in errors
    chain = '<!ENTITY c0 "x">' + "".join(f'<!ENTITY c{k} "&c{k - 1};">' for k in range(1, 40))
    out, depth, errors = one(chain, "&c20; &c39;")
    assert (out, errors) == ("x &c39;", [("TOODEEP", "c32")]) and depth == 40
    assert one(chain, "&c39; &c20;")[0] == "&c39; x"


def test_rows(spark):
    rows = [(1, '<!ENTITY n "one">', "&n;"), (2, '<!ENTITY n "two">', "&n;&n;"), (3, None, "&n;"), (4, '<!ENTITY n "&n;">', None), (5, "", "")]
    got = entities.expanded_documents(spark.createDataFrame(rows, "doc_id long, s string, t string"), "s", "t").collect()
    assert {r.doc_id: (r.expanded, r.depth, [tuple(e) for e in r.errors]) for r in got} == {
        1: ("one", 1, []), 2: ("twotwo", 1, []), 3: ("&n;", 0, [("UNDEFINED", "n")]), 4: (None, 0, []), 5: ("", 0, []),
    }
