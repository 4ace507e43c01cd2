"""Command line: ``python -m lumenflow list`` and ``python -m lumenflow query NAME --data DIR [--out DIR] [--format parquet]``."""

from __future__ import annotations

import argparse

from lumenflow.plans import catalog, gaps, points, tabular, vessels, volumes  # noqa: F401 - the plans register themselves
from lumenflow.session import get_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumenflow", description="Run a named query on a folder of tables.")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    q = sub.add_parser("query", help="run a query")
    q.add_argument("name", choices=sorted(catalog.QUERIES), metavar="NAME")
    q.add_argument("--data", required=True, help="folder of parquet tables")
    q.add_argument("--out", help="folder to write to; the first rows are shown without it")
    q.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    q.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    df = catalog.QUERIES[args.name](get_session(), args.data)
    if args.out:
        df.write.mode("overwrite").format(args.format).options(**({"header": "true"} if args.format == "csv" else {})).save(args.out)
    else:
        df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
