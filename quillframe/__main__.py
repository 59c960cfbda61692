"""Converts a table from one syntax to another: ``python -m quillframe in.csv out --from csv --to xsv``."""

from __future__ import annotations

import argparse

from quillframe.plans.session import local_session
from quillframe.sources import options, readers, sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillframe", description=__doc__, epilog="; ".join(f"{k}: {v}" for k, v in options.helps().items()))
    parser.add_argument("source", help="file, folder or glob")
    parser.add_argument("target", help="folder to write")
    parser.add_argument("--from", dest="source_format", choices=options.FORMATS, help="syntax of the source; sniffed if not given")
    parser.add_argument("--to", dest="target_format", choices=options.FORMATS, required=True)
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="an option of the source syntax")
    args = parser.parse_args(argv)
    spark = local_session()
    given = {}
    for pair in args.set:
        name, _, value = pair.partition("=")
        kind = options.OPTIONS[options.ALIASES.get(name, name)].kind
        given[name] = value.lower() in ("1", "true", "yes") if kind is bool else value.split(",") if kind is list else kind(value)
    fmt = args.source_format
    if fmt is None:
        head = spark.read.text(args.source).limit(10)
        from pyspark.sql import functions as F

        text = head.agg(F.array_join(F.collect_list("value"), "\n").alias("v"))
        fmt = text.select(readers.sniff_format(F.col("v"), F.lit(args.source))).first()[0]
        fmt = {"html": "xml", "tsv": "csv"}.get(fmt, fmt)
    table = readers.read_table(spark, fmt, args.source, **given)
    sinks.write_table(table.drop("_errors", "src"), args.target, args.target_format, "rec_no")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
