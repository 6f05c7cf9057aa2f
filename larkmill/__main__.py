"""Command line: list the queries, run one of them, print its plan."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    from larkmill.plans import registry

    p = argparse.ArgumentParser(prog="python -m larkmill", description=__doc__)
    what = p.add_subparsers(dest="what", required=True)
    what.add_parser("list", help="names of all queries")
    for name, text in (("run", "write or show a query's rows"), ("explain", "show a query's plan")):
        one = what.add_parser(name, help=text)
        one.add_argument("query", choices=sorted(registry.queries()), metavar="QUERY")
        one.add_argument("folder", help="folder of the input tables")
    what.choices["run"].add_argument("--out", help="folder to write a table to; without it 20 rows are shown")
    a = p.parse_args(args)
    if a.what == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    from pyspark.sql import SparkSession

    df = registry.queries()[a.query](SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.folder)
    if a.what == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.parquet(a.out)
    else:
        df.show(truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
