"""``python -m tracewell``: convert, merge and inspect dumps."""

from __future__ import annotations

import argparse
import os
import sys

from tracewell import engine


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewell")
    top.add_argument("--threads", type=int, default=engine.default_threads(os.cpu_count() or 1))
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="dumps to a Parquet table or a trace")
    c.add_argument("dumps", nargs="+")
    c.add_argument("-o", "--output")
    c.add_argument("--format", choices=("parquet", "trace"))
    c.add_argument("--host")
    c.add_argument("--compression-level", type=int, default=3)
    m = sub.add_parser("merge", help="several dumps to one")
    m.add_argument("dumps", nargs="+")
    m.add_argument("-o", "--output", required=True)
    m.add_argument("--no-dedup", action="store_true")
    i = sub.add_parser("inspect", help="what is in a dump")
    i.add_argument("dump")
    sub.add_parser("guide", help="how to query a converted table")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if not 1 <= args.threads <= 4096:
        parser().error("--threads is from 1 to 4096")
    if args.command == "guide":
        print(engine.GUIDE, end="")
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master(f"local[{args.threads}]").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "convert":
        print(engine.convert(spark, args.dumps, args.output, args.format, args.host, args.compression_level))
    elif args.command == "merge":
        print(engine.merge(spark, args.dumps, args.output, not args.no_dedup))
    else:
        print(engine.inspect(spark, args.dump), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
