"""Every datatype over values made from the orders, against tests written for SQL alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import datatypes
from quillframe.plans.registry import query
from quillframe.plans.session import table

#: Values of each order, as expressions that mean the same in both dialects; k, p (price in cents) and the date's parts are columns.
_VALUES = (
    "k", "'-' || k", "'+' || k", "k || '000000000000000000'", "'-' || k || '00000000'", "(p // 100) || '.' || (p % 100)", "'-.' || k", "k || '.'", "k || 'E-' || (k % 10)", "'1' || '.5E' || k", "'INF'", "'NaN'",
    "y || '-' || m || '-' || d", "y || '-' || m || '-' || d || 'T1' || (k % 12) || ':30:45'", "y || '-' || m || '-' || d || 'Z'", "y || '-' || m", "y || '+0' || (k % 10) || ':00'", "'--' || m || '-' || d", "'--' || m", "'---' || d",
    "'1' || (k % 10) || ':0' || (k % 10) || ':59.5'", "'24:00:00'", "'P' || k || 'DT' || (k % 24) || 'H'", "'PT'", "'-P' || k || 'Y'", "status", "priority", "'x:y' || k", "'a b' || k", "'a  b'", "'en-' || k", "'_n.' || k || '-z'", "'é' || k",
    "'true'", "'0'", "'ab' || (k % 10) || (k % 7)", "'abc' || (k % 2) || 'F'", "'QUJD' || 'R' || 'A=='", "'QUI='", "'QUI'", "'(' || k || ')'", "'[' || k", "'http://x/' || k || '?a=b#c'", "'0x' || k", "'0' || (k % 9)", "'<' || k || '>'",
)
_NAMES = r"[A-Za-z_À-ÖØ-öø-ÿ][A-Za-z0-9_.À-ÖØ-öø-ÿ-]*"
_ZONES = r"(Z|[+-](0[0-9]|1[0-4]):[0-5][0-9])?"
_WHOLE = "regexp_full_match(v, '[+-]?[0-9]+')"
_matches = lambda pattern: f"regexp_full_match(v, '{pattern}')"
_between = lambda low, high: f"{_WHOLE} AND TRY_CAST(v AS DECIMAL(38,0)) BETWEEN {low}::DECIMAL(38,0) AND {high}::DECIMAL(38,0)"
_DATE, _CLOCK = "-?[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])", r"(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00)"
#: What each type asks, for SQL; values have no line breaks and no leading white space.
_ASKED = {
    "boolean": "v IN ('true', 'false', '1', '0')", "decimal": _matches(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)"), **{t: _matches(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([Ee][+-]?[0-9]+)?|-?INF|NaN") for t in ("double", "float")}, "integer": _WHOLE,
    "byte": _between(-128, 127), "short": _between(-32768, 32767), "int": _between(-(2**31), 2**31 - 1), "long": _between(-(2**63), 2**63 - 1),
    "unsignedByte": _between(0, 255), "unsignedShort": _between(0, 65535), "unsignedInt": _between(0, 2**32 - 1), "unsignedLong": _between(0, 2**64 - 1),
    "nonNegativeInteger": f"{_WHOLE} AND NOT regexp_matches(v, '^-0*[1-9]')", "positiveInteger": _matches(r"\\+?0*[1-9][0-9]*".replace("\\\\", "\\")), "nonPositiveInteger": f"{_WHOLE} AND NOT regexp_matches(v, '^[+]?0*[1-9]')", "negativeInteger": _matches("-0*[1-9][0-9]*"),
    "date": _matches(_DATE + _ZONES), "dateTime": _matches(f"{_DATE}T{_CLOCK}{_ZONES}"), "time": _matches(_CLOCK + _ZONES), "gDay": _matches(f"---(0[1-9]|[12][0-9]|3[01]){_ZONES}"), "gMonth": _matches(f"--(0[1-9]|1[0-2]){_ZONES}"),
    "gMonthDay": _matches(f"--(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01]){_ZONES}"), "gYear": _matches(f"-?([1-9][0-9]{{3,}}|0[0-9]{{3}}){_ZONES}"), "gYearMonth": _matches(f"-?([1-9][0-9]{{3,}}|0[0-9]{{3}})-(0[1-9]|1[0-2]){_ZONES}"),
    "duration": _matches("-?P([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T([0-9]+H)?([0-9]+M)?([0-9]+S)?)?") + " AND NOT regexp_matches(v, '[PT]$')", "language": _matches("[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*"),
    "normalizedString": "true", "string": "true", "STRING": _matches("[a-z].*"), "token": "NOT contains(v, '  ')", "NMTOKEN": _matches("[A-Za-z0-9_.:À-ÖØ-öø-ÿ-]+"), "NMTOKENS": _matches("[A-Za-z0-9_.:À-ÖØ-öø-ÿ -]+"), "Name": _matches(_NAMES.replace("_À", "_:À").replace("_.À", "_.:À")),
    **{t: _matches(_NAMES) for t in ("NCName", "ID", "IDREF", "ENTITY")}, **{t: _matches(f"{_NAMES}( +{_NAMES})*") for t in ("IDREFS", "ENTITIES")}, "QName": _matches(f"({_NAMES}:)?{_NAMES}"), "anyURI": "NOT regexp_matches(v, '[ <>]')",
    "base64Binary": "length(replace(v, ' ', '')) % 4 = 0 AND " + _matches("([A-Za-z0-9+/] ?)*(==|=)?"), "hexBinary": "length(v) % 2 = 0 AND " + _matches("[0-9A-Fa-f]*"), "ENUM": "v IN ('F', 'O')", "REGEX": "NOT regexp_matches(v, '^\\[|^[+]')", "ASCII": "NOT contains(v, 'é')",
    "BASEINT": _matches("0[xX][0-9A-Fa-f]+|0[0-7]*|[1-9][0-9]*"),
}
_ARGUMENTS = {"ENUM": "ENUM(F O)", "STRING": "STRING([a-z].*)"}
_ORDERS = "SELECT o_orderkey AS k, (round(o_totalprice * 100))::BIGINT AS p, o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%d') AS d FROM orders"
_LISTED = ", ".join(f"({v})::VARCHAR" for v in _VALUES)
_COUNTS = ", ".join(f"'{t}': count(*) FILTER ({asked})" for t, asked in _ASKED.items())


@query(f"SELECT unnest(map_keys(m)) AS type, unnest(map_values(m)) AS good FROM (SELECT MAP {{{_COUNTS}}} AS m FROM (SELECT unnest([{_LISTED}]) AS v FROM ({_ORDERS})))")
def all_types_report(spark, sf_dir):
    """How many of the values conform to each of the datatypes."""
    # dealt out first: a file of a few MB is read by one task, however many values are made from it
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = lambda form: F.date_format("o_orderdate", form)
    rows = orders.select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("p"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), part("yyyy").alias("y"), part("MM").alias("m"), part("dd").alias("d"))
    values = rows.select(F.explode(F.array(*[F.expr(v.replace("//", "div")).cast("string") for v in _VALUES])).alias("v"))
    values = values.groupBy("v").agg(F.count("*").alias("n"))
    # names that differ in case alone are one to the planner
    times = lambda good: F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0))
    counts = values.agg(*[times(datatypes.conforms(F.col("v"), _ARGUMENTS.get(t, t) + "!")).alias(f"_{k}") for k, t in enumerate(datatypes.TYPES)])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, datatypes.TYPES)), F.array(*[f"_{k}" for k in range(len(datatypes.TYPES))]))).alias("type", "good"))
