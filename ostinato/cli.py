"""Command line: detect rhythms in a table, score methods on simulated series or on tables with known symbols, show the version."""

from __future__ import annotations

import argparse
import sys

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ostinato")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("detect")
    d.add_argument("input")
    d.add_argument("output")
    d.add_argument("-t", "--timepoints", help="comma-separated hours, if the headers aren't")
    d.add_argument("--method", choices=["analytic", "dynamic", "both", "two_stage"], default="analytic")
    b = sub.add_parser("benchmark")
    b.add_argument("output")
    b.add_argument("--replicates", type=int, default=5)
    r = sub.add_parser("benchmark-real")
    r.add_argument("output")
    r.add_argument("--lists", required=True, help="a table with the columns symbol and category (known_12h, core_circadian, housekeeping)")
    r.add_argument("--dataset", action="append", required=True, metavar="NAME=PATH", help="a table of series by times; several are allowed")
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    from pyspark.sql import SparkSession

    from . import api
    from .sources import readers

    spark = SparkSession.builder.appName("ostinato").getOrCreate()
    if a.command == "benchmark-real":
        from . import validation
        from .operators import series

        try:
            pairs = [d.partition("=")[::2] for d in a.dataset]
            data = {name: series.to_array(readers.matrix_csv(spark, path)) for name, path in pairs}
            rows = validation.benchmark(data, readers.delimited(spark, a.lists, ["symbol", "category"], ","))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        rows = rows.persist()  # written, and read for each summary
        readers.write_csv(rows, f"{a.output}/rows")
        for name, table in validation.summary(rows).items():
            readers.write_csv(table, f"{a.output}/{name}")
        rows.unpersist()
        return 0
    if a.command == "detect":
        try:
            long = readers.matrix_csv(spark, a.input, [float(x) for x in a.timepoints.split(",")] if a.timepoints else None)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        out = api.run(long, method=a.method)
    else:
        out = api.benchmark(spark, a.replicates)
    readers.write_csv(out, a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
