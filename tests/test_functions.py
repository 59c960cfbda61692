import pytest
from pyspark.sql import functions as F

from quillframe.functions import datatypes, scalars, udfs
from quillframe.operators import schema, tokens


def value(spark, column, **given):
    df = spark.createDataFrame([tuple(given.values()) or (1,)], list(given) or ["one"])
    return df.select(column).first()[0]


C = F.col


@pytest.mark.parametrize(
    "make,x,expected",
    [
        (lambda x: scalars.trim(x), " \t a b\n ", "a b"),
        (lambda x: scalars.sentence_case(x, True), "hELLO World", "Hello world"),
        (lambda x: scalars.title_case(x), "well-known o'clock", "Well-Known O'clock"),
        (lambda x: scalars.lpad(x, 3), "12345", "12345"),
        (lambda x: scalars.lpad(x, 7), "12345", "0012345"),
        (lambda x: scalars.cpad(x, 6, "*"), "abc", "*abc**"),
        (lambda x: scalars.rpad(x, 6, " ", '"'), "abc", '"abc" '),
        (lambda x: scalars.align(x, 8, "D"), "3.25", "   3.25 "),
        (lambda x: scalars.align(x, 3, "L", True), "abcdef", "abc"),
        (lambda x: scalars.safe_substring(x, 9, 2), "abc", ""),
        (lambda x: scalars.safe_substring(x, -2, 2), "abc", "bc"),
        (lambda x: scalars.escape_json(x), 'a"b\\\n', 'a\\"b\\\\\\n'),
        (lambda x: scalars.escape_xml_attribute(x), 'a<b>"&\x01', "a&lt;b>&quot;&amp;"),
        (lambda x: scalars.escape_xml_comment(x), "a--b", "a- -b"),
        (lambda x: scalars.escape_uri(x), "a b%~*", "a%20b%25~%2A"),
        (lambda x: scalars.unescape_uri(x), "a+b%20c%C3%A9", "a+b cé"),
        (lambda x: scalars.show_controls(x), "a b\n", "a␠b␊"),
        (lambda x: scalars.escape_regex(x, "-"), "a.b-c", r"a\.b\-c"),
        (lambda x: scalars.make_xml_name(x), "1 a", "_1_a"),
        (lambda x: scalars.split_path(x)["ext"], "/x/y.tar.gz", "gz"),
        (lambda x: scalars.split_path(x)["base"], "/x/y.tar.gz", "y.tar"),
        (lambda x: F.array_join(scalars.split_escaped(x), "|"), "a\\,b,c,,d", "a,b|c||d"),
        (lambda x: F.array_join(scalars.split_escaped(x, empties=False), "|"), "a,,b", "a|b"),
        (lambda x: scalars.uncolored(scalars.colorize(x, "red//bold")), "abc", "abc"),
        (lambda x: udfs.unbackslashed(x), r"\x41é\t\x{1F642}\101\q", "Aé\t\U0001f642Aq"),
        (lambda x: udfs.stripped_marks(x), "Été ﬁ", "Ete fi"),
        (lambda x: udfs.unescape_entities(x), "&eacute;&#65;&amp;", "éA&"),
        (lambda x: udfs.wrapped(x, 7, 1), "aaa bbb ccc", "aaa bbb\n ccc"),
        (lambda x: udfs.unescaped_xml_name(udfs.escaped_xml_name(x)), "a b-c", "a b-c"),
        (lambda x: udfs.indented_xml(x), "<a><b>x</b></a>", "<a>\n  <b>x\n  </b>\n</a>"),
        (lambda x: tokens.simplify(x), "“Ærø—Straße”", '"AEro-Strasse"'),
        (lambda x: tokens.cp1252_repair(x), "\x80\x93\x81", "€“?"),
        (lambda x: tokens.expand_contractions(x), "I won't, she'll, they aren't", "I will not, she will, they are not"),
        (lambda x: tokens.shorten(x, tokens.TokenOptions(n_char=3)), "aaaaaaaarrrrgh", "aaarrrgh"),
        (lambda x: F.array_join(tokens.tokenize(x), "|"), "Hello, (world)... wait--what? End.", "Hello|,|(|world|)|...|wait|--|what|?|End|."),
        (lambda x: tokens.dispose(x, r"\p{No}", "value", ""), "½x", "0.5x"),
    ],
)
def test_text_function(spark, make, x, expected):
    assert value(spark, make(C("x")), x=x) == expected


def test_numbers(spark):
    assert value(spark, scalars.to_human(C("n").cast("double")), n=1024) == "1.00K"
    assert value(spark, scalars.to_human(C("n").cast("double"), 1000), n=1000) == "1.00K"
    assert value(spark, scalars.from_human(C("s")), s="2.5M") == 2.5 * 1024**2
    assert value(spark, scalars.utf8_bytes(C("n")), n=3000) == "%e0%ae%b8"
    assert value(spark, scalars.elapsed(F.lit(10), F.lit(3671))) == "01:01:01"
    assert value(spark, scalars.nearest_cube_level(C("n")), n=115) == 95


GOOD = {
    "boolean!": ("true", "0"), "byte!": ("-128", "127"), "unsignedByte!": ("255",), "int!": ("2147483647",), "unsignedLong!": ("18446744073709551615",), "decimal!": ("1", "-.5"),
    "double!": ("1e5", "INF", "NaN"), "date!": ("2024-02-29", "2024-01-01Z"), "time!": ("24:00:00", "23:59:59.5"), "duration!": ("P1Y2M", "-PT1.5S"), "gMonthDay!": ("--12-31",),
    "NMTOKENS!": ("a 1b",), "NCName!": ("_a-b.c",), "hexBinary!": ("0aFF",), "base64Binary!": ("YWJj",), "ENUM(Spam Eggs)!": ("Spam",), "STRING([ab]+)!": ("abba",), "REGEX!": ("a(b)",),
    "BASEINT!": ("0x1F", "017", "9"), "integer?": ("", None), "IDREFS+": ("a b",), "integer*": ("1 2 3", ""),
}
BAD = {
    "boolean!": ("yes", ""), "byte!": ("128", "-129", "1.0"), "unsignedByte!": ("-1", "256"), "int!": ("2147483648",), "unsignedLong!": ("18446744073709551616",), "decimal!": ("1e5",),
    "date!": ("2024-13-01",), "time!": ("24:00:01",), "duration!": ("P", "PT"), "NCName!": ("a:b", "1a"), "hexBinary!": ("abc",), "ENUM(Spam Eggs)!": ("ENUM",), "STRING([ab]+)!": ("abc",),
    "REGEX!": ("a(",), "BASEINT!": ("09", "x"), "integer!": (None, "1\n2"), "integer+": ("", "1 x"), "negativeInteger!": ("0",),
}


def test_datatypes(spark):
    for wanted, cases in ((True, GOOD), (False, BAD)):
        for spec, values in cases.items():
            df = spark.createDataFrame([(v,) for v in values], "v string")
            assert [r[0] for r in df.select(datatypes.conforms(F.col("v"), spec)).collect()] == [wanted] * len(values), spec


def test_schema(spark):
    s = schema.TableSchema()
    s.set_positions([0, 10, 21])
    s.rename_all(["a", None, "c"])
    assert s.names == ["a", "F_2", "c"] and [f.width for f in s.fields] == [10, 11, 8]
    assert s.available_width("a") == 10 and s.following("F_2").name == "c" and s.number("3") == 3
    with pytest.raises(ValueError):
        s.append("a")
    with pytest.raises(ValueError):
        s.set_position("c", 5, 3)
    assert schema.header_names(["a b", "", "9x", "ok"]) == ["a_b", "F_2", "A_9x", "ok"]
    assert s.get(5, create=True).name == "F_5"


def test_contractions(spark):
    from quillframe.operators import tokens

    cases = {
        "it's coulda who's c'mon": "it is could have who is come on", "I'm sure, we've won't; they'll!": "I am sure, we have will not; they will!",
        "John's book isn't “gonna” (can't)": "John's book is not “going to” (can not)", "What'd you say? 'Tis  whaddya": "what would you say? it is  what do you", "plain text": "plain text", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tokens.expand_contractions(F.col("t")).alias("x")).collect()
    assert {r["t"].lower(): r["x"].lower() for r in rows} == {k.lower(): v.lower() for k, v in cases.items()}


def test_sentence_ends(spark):
    from quillframe.operators import tokens

    text = "Dr. Smith met J. Doe. They left in May. Now"
    got = spark.createDataFrame([(text,)], "t string").select(tokens.tokenize(F.col("t"))).first()[0]
    assert got == "Dr. Smith met J. Doe . They left in May . Now".split()


def test_ranges_of_text_and_dates(spark):
    """Record numbers over keys of any ordered type, without a single range."""
    import datetime

    from quillframe.operators import records

    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=k * 7 % 400) for k in range(400)]
    df = spark.createDataFrame([(f"k{k * 37 % 400:04}", days[k]) for k in range(400)] + [(None, None)], "k string, d date")
    for column in ("k", "d"):
        rows = records.numbered(df.filter(f"{column} is not null"), [column]).select(column, "rec_no").collect()
        assert [r["rec_no"] for r in sorted(rows)] == list(range(1, 401))
        assert len(records._cuts(df, column, 4)) == 3
