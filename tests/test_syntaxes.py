"""Five rows in every syntax: each reads to the same table, and every pair of syntaxes round-trips."""

import itertools

import pytest

from quillframe.sources import readers, sinks

NAMES = ["Id", "item", "maker", "shelf"]
ROWS = [
    ("k-17", "lamp", "Orlo", "B2"),
    ("k-18", "clock", "Tessel", "C7"),
    ("k-19", "lamp", "Brund", "B2"),
    ("k-20", "chair", 'Quist "Q"', "D4"),
    ("k-21", "globe", "de Wit", "D4"),
]
OPTIONS = {"columns": {"positions": [0, 10, 22, 34]}}


def written(spark, fmt):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS, 1)], "rec_no long, Id string, item string, maker string, shelf string")
    return sinks.assembled(df, fmt, "rec_no", **OPTIONS.get(fmt, {})).first()[0]


def read(spark, fmt, text):
    extra = {"field_names": NAMES} if fmt == "columns" else {}
    return readers.read_table(spark, fmt, text, path=False, **OPTIONS.get(fmt, {}), **extra)


@pytest.mark.parametrize("fmt", sorted(readers.READERS))
def test_round_trip(spark, fmt):
    rows = read(spark, fmt, written(spark, fmt)).orderBy("rec_no").select(*NAMES).collect()
    assert [tuple(r) for r in rows] == ROWS


HAND = {
    "csv": 'Id, item, maker, shelf\nk-17, lamp, Orlo, B2\nk-21, globe, "de Wit", D4\n',
    "arff": "% goods\n@RELATION s\n@ATTRIBUTE Id STRING\n@ATTRIBUTE item STRING\n@ATTRIBUTE maker STRING\n@ATTRIBUTE shelf {B2, D4}\n@DATA\nk-17,lamp,Orlo,B2\nk-21,globe,'de Wit',D4\n",
    "json": '{"Table": [ {"Id": "k-17", "item": "lamp", "maker": "Orlo", "shelf": "B2"},\n {"Id": "k-21", "item": "globe", "maker": "de Wit", "shelf": "D4"} ]}',
    "mime": "Id: k-17\nitem: lamp\nmaker: Orlo\nshelf: B2\n\nId: k-21\nitem: globe\nmaker: de\n Wit\nshelf: D4\n",
    "manchester": "# c\nPrefix: : <x>\nClass: P\nIndividual: k-17\n  Types: P\n  Facts: item lamp,\n   maker Orlo, shelf B2\nIndividual: k-21\n  Facts: item globe, maker 'de Wit', shelf D4\n",
    "sexp": "((Id 'k-17') (item 'lamp') (maker 'Orlo') (shelf 'B2'))\n((Id 'k-21') (item 'globe') (maker 'de Wit') (shelf 'D4'))",
    "perl": 'my @x = ( { "Id" => "k-17", "item" => \'lamp\', "maker" => "Orlo", "shelf" => "B2" },\n { "Id" => "k-21", "item" => "globe", "maker" => "de Wit", "shelf" => "D4" } );',
    "xml": '<table><tr><td class="Id">k-17</td><td class="item">lamp</td><td class="maker">Orlo</td><td class="shelf">B2</td></tr>\n<tr><Id>k-21</Id><item>globe</item><maker>de&#x20;Wit</maker><shelf>D4</shelf></tr></table>',
    "xsv": '<Xsv><Head Id="#NCName!#" item="" maker="Orlo" shelf="#ENUM(B2 D4)#B2">\n<Rec Id="k-17" item="lamp"/>\n<Rec Id="k-21" item="globe" maker="de Wit" shelf="D4" /></Head></Xsv>',
}


@pytest.mark.parametrize("fmt", sorted(HAND))
def test_hand_written(spark, fmt):
    rows = read(spark, fmt, HAND[fmt]).orderBy("rec_no").select(*NAMES).collect()
    assert [tuple(r) for r in rows] == [ROWS[0], ROWS[4]]


def test_arff_missing_and_sparse(spark):
    text = "@RELATION s\n@ATTRIBUTE a STRING\n@ATTRIBUTE b NUMERIC\n@ATTRIBUTE c STRING\n@DATA\nx,?,'p, q'\n{0 lamp, 2 B2}\n"
    rows = readers.read_table(spark, "arff", text, path=False).orderBy("rec_no").select("a", "b", "c").collect()
    assert [tuple(r) for r in rows] == [("x", None, "p, q"), ("lamp", "0", "B2")]


CELLS = [
    ("a,b,c", ["a", "b", "c"]), (",b,", ["", "b", ""]), ("  a , b ", ["a", "b"]), ('"a,b",c', ["a,b", "c"]), ('"",x', ["", "x"]), ('"a ""q"" b",c', ['a "q" b', "c"]),
    ('a,"b"', ["a", "b"]), ('"a"', ["a"]), ("0", ["0"]), ('a,0', ["a", "0"]), ('"a",', ["a", ""]), (' "a" , b', ["a", "b"]), ('a b,"c\td"', ["a b", "c\td"]), ('"x""",y', ['x"', "y"]),
]


@pytest.mark.parametrize("text,expected", CELLS)
def test_csv_cells(spark, text, expected):
    df = readers.read_table(spark, "csv", text, path=False, header=False, field_names=[f"c{k}" for k in range(len(expected))])
    assert list(df.first()[2:]) == expected


def test_csv_escapes_and_line_breaks(spark):
    df = readers.read_table(spark, "csv", 'a,b\n"x\ny",z\n', path=False, nl_in_quotes=True)
    assert [tuple(r) for r in df.select("a", "b").collect()] == [("x\ny", "z")]
    df = readers.read_table(spark, "csv", 'a|b\n"p\\"q"|r\\|s\n', path=False, field_sep="|", escape="\\", qdouble=False)
    assert [tuple(r) for r in df.select("a", "b").collect()] == [('p"q', "r|s")]


def test_xsv_errors(spark):
    text = '<Xsv><Head Id="#NCName!#" N="#integer?#1" Kind="#ENUM(a b)#a"><Rec N="7"/><Rec Id="x" N="q" Kind="c" Zz="1"/><Rec Id="y"/></Head></Xsv>'
    rows = readers.read_table(spark, "xsv", text, path=False).orderBy("rec_no").collect()
    assert sorted((e["code"], e["field"]) for e in rows[0]["_errors"]) == [("REQATTR", "Id")]
    assert sorted((e["code"], e["field"]) for e in rows[1]["_errors"]) == [("ATTRTYPE", "Kind"), ("ATTRTYPE", "N"), ("UNKATTR", "Zz")]
    assert (rows[2]["N"], rows[2]["Kind"], rows[2]["_errors"]) == ("1", "a", [])


def test_sniffing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a;b;c,d",), ("a\tb\tc",), ('"x,y,z";b',), ("a b c",)], "v string")
    assert [r[0] for r in df.select(readers.sniff_delimiter(F.col("v"))).collect()] == [";", "\t", ";", r"\s+"]
    for fmt in ("arff", "xsv", "sexp", "json", "perl", "mime"):
        got = spark.createDataFrame([(written(spark, fmt),)], "v string").select(readers.sniff_format(F.col("v"))).first()[0]
        assert got == fmt, fmt


def test_options_are_checked():
    from quillframe.sources import options

    assert options.resolve(delim="\\t")["field_sep"] == "\t"
    for bad in ({"nope": 1}, {"header": "yes"}, {"quote": "ab"}):
        with pytest.raises((ValueError, TypeError)):
            options.resolve(**bad)


@pytest.mark.parametrize("a,b", list(itertools.permutations(["csv", "arff", "mime", "xsv", "json"], 2))[::5])
def test_conversion(spark, a, b):
    table = read(spark, a, written(spark, a)).select("rec_no", *NAMES)
    text = sinks.assembled(table, b, "rec_no").first()[0]
    assert [tuple(r) for r in read(spark, b, text).orderBy("rec_no").select(*NAMES).collect()] == ROWS


def test_csv_escape_decoding(spark):
    """Letters, octal, hexadecimal and code points behind the escape character, in quotes and out of them."""
    text = 'v,w\na\\tb\\n,"q\\"\\\\\\101\\x42\\x{43}\\u0044\\U00000045\\,z"\n'
    rows = readers.read_table(spark, "csv", text, path=False, escape="\\").collect()
    assert [(r["v"], r["w"]) for r in rows] == [("a\tb\n", 'q"\\ABCDE,z')]


@pytest.mark.parametrize("options", [{"escape": "\\"}, {"escape": "\\", "nl_in_quotes": False}, {}, {"escape": "~"}])
def test_csv_hostile_values(spark, options):
    values = ["a\\b", 'say "x"', "line\nbreak", "a,b", "", "~tilde~", "tab\there", "\\", 'end"', "n\\n", "x\r\ny" if options.get("escape") else "plain", " padded "]
    df = spark.createDataFrame([(k, v, "z") for k, v in enumerate(values)], "rec_no long, v string, w string")
    from quillframe.sources import sinks

    doc = sinks.assembled(df, "csv", "rec_no", **options).select(sinks.F.lit("s").alias("src"), "value")
    got = [r["v"] for r in readers.parse_table(doc, "csv", **options).orderBy("rec_no").collect()]
    assert got == [v.replace("\r\n", "\n") if options.get("nl_in_quotes", True) else v for v in values]


@pytest.mark.parametrize(("fmt", "text", "field", "want"), [
    ("mime", "To: a\nReceived: 1\nReceived: 2\n", "Received", "2"), ("xml", "<table><tr><td>1</td><td>2</td></tr></table>", "td", "2"),
    ("perl", 'my @x = ( { "a" => 1, "a" => 2 }, );', "a", "2"), ("sexp", '(SEXP (tr (a "1") (a "2")))', "a", "2"),
    ("manchester", 'Individual: i\n    Facts: a 1,\n        a "say \\"2\\""\n', "a", 'say "2"'), ("xsv", '<Xsv><Head a=""><Rec a="1" a="2" /></Head></Xsv>', "a", "2"),
])
def test_repeated_names_last_counts(spark, fmt, text, field, want):
    assert [r[field] for r in readers.read_table(spark, fmt, text, path=False).collect()] == [want]
