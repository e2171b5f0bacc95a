"""The command line: galley convert SOURCE FOLDER, galley infer SOURCE TABLE."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from galley import api, errors
from galley.layout import ir


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="galley")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="pages of JSON lines to packages")
    c.add_argument("source")
    c.add_argument("folder")
    c.add_argument("--target", default="word")
    c.add_argument("--oracle", default="none")
    c.add_argument("--rounds", type=int, default=0)
    c.add_argument("--max-pages", type=int, default=api.MOST_PAGES)
    c.add_argument("--continue", dest="going", action="store_true")
    i = sub.add_parser("infer", help="pages of JSON lines to a Parquet table of elements")
    i.add_argument("source")
    i.add_argument("table")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 0, or that of the error, which goes to the error stream as JSON."""
    args = parser().parse_args(argv)
    try:
        if args.command == "convert":
            options = api.Options.of({"target": args.target, "oracle": args.oracle, "rounds": args.rounds, "max_pages": args.max_pages, "continue_on_error": args.going})
        spark = spark or SparkSession.builder.appName("galley").getOrCreate()
        if args.command == "convert":
            print(api.report(api.convert(spark, args.source, args.folder, options)))
        else:
            api.infer(ir.objects(ir.read_pages(spark, args.source))).write.mode("errorifexists").parquet(args.table)
    except errors.GalleyError as e:
        print(json.dumps(errors.safe(e)), file=sys.stderr)
        return e.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
