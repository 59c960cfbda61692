"""Files read by blocks against the same files as one text, headers by file, documents of parts, and writes that fail."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillframe.operators import schema
from quillframe.sources import readers, sinks, splits

HOSTILE = ["plain", "", None, " ends with spaces ", "a\nb", "\n", "\r\n", 'q"q', "it's", "a,b;c\td", "back\\slash", "\\n", "{x}", "(y)", "<z a='1'>&amp;", "% note", "# note", "?", "undef", "null", "12", "-0.5", "é日\U0001f642", "x" * 5000]


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "600")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def rows_of(df):
    return [tuple(r) for r in df.drop("src").orderBy("rec_no").collect()]


@pytest.mark.parametrize("options", [{}, {"comment": "#"}, {"escape": "\\", "qdouble": False}, {"nl_in_quotes": False}, {"strip_records": True}], ids=str)
def test_blocks_equal_one_text(spark, small_blocks, tmp_path, options):
    """Records over any number of lines and blocks, comments with quotes in them, a quote that never ends."""
    rng = random.Random(7)
    pieces = ["a", "b,c", '"x\ny"', "\n", "\n", '"q""r"', ",", '"long\n\nrecord\n of, lines"', '# "odd\n', "\n# it's \"\n", '\\"', " \r\n", '"' + "far\n" * 300 + '"\n']
    path = tmp_path / "t.csv"
    path.write_bytes("".join(rng.choice(pieces) for _ in range(900)).encode())
    given = {"header": False, "field_names": ["a", "b", "c"], **options}
    by_blocks = readers.read_table(spark, "csv", str(path), **given)
    whole = readers.parse_table(readers.texts(spark, str(path), whole=True, path=True), "csv", **given)
    assert readers.splits.block_lines(spark, str(path)).select("block").distinct().count() > 5
    assert rows_of(by_blocks) == rows_of(whole)


def test_states_compose():
    """Every line function against a plain loop, from both states."""
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(12)
        odd, notes = ([rng.random() < 0.4 for _ in range(n)] for _ in range(2))
        for state in (0, 1):
            expected, at = [], state
            for o, c in zip(odd, notes, strict=True):
                expected.append(at)
                at = (at if not o else 0 if c else 1 - at)
            import numpy as np

            got = splits.LineStates.before(np.array(odd, bool), np.array(notes, bool), state)
            assert got.tolist() == [*expected, at]


def test_headers_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("# note\n\ny,x,z\n20,10,30\n")
    (tmp_path / "c.csv").write_text("y,x\n")
    for df in (
        readers.read_table(spark, "csv", str(tmp_path / "*.csv"), comment="#"),
        readers.parse_table(readers.texts(spark, str(tmp_path / "*.csv"), True, True), "csv", comment="#"),
    ):
        assert sorted(tuple(r)[1:] for r in df.select("src", "rec_no", "x", "y", "z").collect()) == [(1, "1", "2", None), (1, "10", "20", "30")]


def test_arff_headers_by_file(spark, tmp_path):
    (tmp_path / "a.arff").write_text("@RELATION r\n@ATTRIBUTE x STRING\n@ATTRIBUTE y NUMERIC\n@DATA\n'p q',1\n% note\n{1 5}\n")
    (tmp_path / "b.arff").write_text("% first\n@RELATION r\n@ATTRIBUTE y NUMERIC\n@ATTRIBUTE x STRING\n@ATTRIBUTE w STRING\n@DATA\n2,z,v\n{0 7}\n")
    whole = readers.parse_table(readers.texts(spark, str(tmp_path / "*.arff"), True, True), "arff")
    for df in (readers.read_table(spark, "arff", str(tmp_path / "*.arff")), whole):
        got = sorted(((r["src"][-6:], r["rec_no"], r["x"], r["y"], r["w"]) for r in df.collect()), key=str)
        assert got == [("a.arff", 1, "p q", "1", None), ("a.arff", 3, "0", "5", None), ("b.arff", 1, "z", "2", "v"), ("b.arff", 2, "0", "7", "0")]


def test_tuple_heads_by_text(spark):
    one = '<Xsv>\n<Head a="1" b="">\n<Rec b="x" />\n</Head>\n</Xsv>'
    two = '<Xsv>\n<Head b="" c="#string#z">\n<Rec b="y" />\n</Head>\n</Xsv>'
    rows = readers.read_table(spark, "xsv", [one, two], path=False).orderBy("src").collect()
    assert [(r["a"], r["b"], r["c"], r["_errors"]) for r in rows] == [("1", "x", None, []), (None, "y", "z", [])]


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert readers.read_table(spark, "csv", str(tmp_path)).count() == 0
    assert readers.read_table(spark, "arff", str(tmp_path)).count() == 0
    assert splits.read_lines(spark, str(tmp_path)).count() == 0


def expected_text(fmt, v):
    """What a syntax keeps of a value: no difference of empty and missing in csv, no space around values in xml, no breaks in mime."""
    if fmt == "csv":
        return (v or "").replace("\r\n", "\n")
    if fmt == "xml":
        return (v or "").strip()
    if fmt == "mime" and v is not None:
        return re.sub(r"\s*\n\s*", " ", v).lstrip()
    return v


@pytest.mark.parametrize("fmt", ["arff", "csv", "json", "xml", "xsv", "perl", "sexp", "manchester", "mime"])
def test_hostile_values_through_documents_of_parts(spark, tmp_path, fmt):
    rows = [(k + 1, f"id{k}", v, "end") for k, v in enumerate(HOSTILE)]
    df = spark.createDataFrame(rows, "rec_no long, Id string, v string, w string").repartition(5)
    sinks.write_document(df, str(tmp_path / "out"), fmt, "rec_no")
    names = {"field_names": ["Id", "v", "w"]}
    got = readers.read_table(spark, fmt, str(tmp_path / "out"), one_document=True, **({} if fmt in ("csv", "arff", "xsv") else names))
    found = {r["rec_no"]: (r["Id"], r["v"], r["w"]) for r in got.collect()}
    assert found == {n: (i, expected_text(fmt, v), w) for n, i, v, w in rows}


def test_hostile_names_of_individuals(spark, tmp_path):
    rows = [(k + 1, v, "w") for k, v in enumerate([*HOSTILE, "_:", "Facts:", "two words"])]
    sinks.write_document(spark.createDataFrame(rows, "rec_no long, name string, v string"), str(tmp_path / "m"), "manchester", "rec_no")
    got = readers.read_table(spark, "manchester", str(tmp_path / "m"), one_document=True, field_names=["Id", "v"])
    assert {r["rec_no"]: (r["Id"], r["v"]) for r in got.collect()} == {n: (i, v) for n, i, v in rows}


def test_parts_make_one_json_document(spark, tmp_path):
    import json

    df = spark.range(1, 40).select(F.col("id").alias("rec_no"), F.col("id").alias("n"))
    sinks.write_document(df, str(tmp_path / "j"), "json", "rec_no")
    parts = sorted(p for p in os.listdir(tmp_path / "j") if p.startswith("part-"))
    assert len(parts) > 3
    text = "".join((tmp_path / "j" / p).read_text() for p in parts)
    assert [r["n"] for r in json.loads(text)["Table"]] == list(range(1, 40))


def test_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(1, 40).select(F.col("id").alias("rec_no"), F.when(F.col("id") == 30, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("v"))
    with pytest.raises(Exception, match="no"):
        sinks.write_document(df, str(tmp_path / "f"), "xml", "rec_no")
    assert not os.path.exists(tmp_path / "f")


def test_overwrite_is_asked_for(spark, tmp_path):
    df = spark.range(1, 5).select(F.col("id").alias("rec_no"), F.col("id").alias("v"))
    sinks.write_document(df, str(tmp_path / "o"), "xml", "rec_no")
    with pytest.raises(Exception, match="not empty"):
        sinks.write_document(df, str(tmp_path / "o"), "xml", "rec_no")
    sinks.write_document(df.filter("rec_no < 3"), str(tmp_path / "o"), "xml", "rec_no", overwrite=True)
    assert readers.read_table(spark, "xml", str(tmp_path / "o"), one_document=True).count() == 2


def test_empty_document(spark, tmp_path):
    df = spark.createDataFrame([], "rec_no long, v string, w string")
    for fmt in ("json", "xml", "csv", "xsv"):
        sinks.write_document(df, str(tmp_path / fmt), fmt, "rec_no")
        assert readers.read_table(spark, fmt, str(tmp_path / fmt), one_document=True).count() == 0
    assert schema.header_names(["v", "w"]) == ["v", "w"]


def test_balanced_pieces_against_a_plain_loop():
    """Brackets, quotes inside pieces only, escapes and comments, in random texts."""
    from quillframe.sources.scanner import balanced

    def plain(text, comment):
        out, stack, quote, start, k = [], [], "", 0, 0
        while k < len(text):
            c = text[k]
            if quote:
                k += c == "\\"
                quote = "" if c == quote else quote
            elif comment and c == comment:
                k = text.find("\n", k) if "\n" in text[k:] else len(text)
            elif c in "\"'" and stack:
                quote = c
            elif c in "([{":
                start = start if stack else k
                stack.append(c)
            elif c in ")]}":
                if stack and stack.pop() == {")": "(", "]": "[", "}": "{"}[c]:
                    if not stack:
                        out.append(text[start : k + 1])
                else:
                    stack.clear()
            k += 1
        return out

    rng = random.Random(6)
    for _ in range(5000):
        text = "".join(rng.choice("()[]{}\"'\\#ab\n") for _ in range(rng.randrange(25)))
        for comment in ("", "#"):
            assert list(balanced(text, comment=comment)) == plain(text, comment), text
