"""The command line: python -m millrace.cli COMMAND FOLDER ..., each command over the tables of one folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from millrace.engine.session import Engine
from millrace.errors import SqlError
from millrace.operators import analytics
from millrace.sources.csv_import import import_csv
from millrace.sources.dump import dump, restore
from millrace.sources.render import render

COMMANDS = {
    "new": "makes an empty database", "list": "names of the tables", "delete": "deletes the database", "check": "checks all constraints against the data",
    "checkpoint": "deletes data that no version names any more", "schema": "CREATE TABLE of a table", "query": "runs statements", "dump": "SQL text of all tables",
    "restore": "runs a dump in an empty database", "import": "rows of a CSV file into a table", "stats": "figures of each column", "sample": "rows at random", "profile": "bounds and most frequent values of each column",
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        own = commands.add_parser(name, help=text)
        own.add_argument("folder")
        if name in ("query", "restore", "import"):
            own.add_argument({"query": "sql"}.get(name, "file"))
        if name in ("schema", "import", "stats", "sample", "profile"):
            own.add_argument("table")
        if name in ("query", "stats", "sample", "profile"):
            own.add_argument("--format", default="csv" if name != "query" else "table")
        if name == "sample":
            own.add_argument("--n", type=int, default=10)
        if name == "profile":
            own.add_argument("--top", type=int, default=5)
    return parser


def _run(args: argparse.Namespace, spark: SparkSession) -> None:
    engine = Engine(spark, args.folder)
    show = lambda df: print(render(df, args.format), end="")
    if args.command == "new":
        if engine.store.version:
            raise SqlError(f"{args.folder} is a database already")
        engine.store.commit({}, {})
    elif args.command == "list":
        for name in sorted(engine.tables):
            print(name)
    elif args.command == "delete":
        engine.store._fs.delete(engine.store._path(engine.store.root), True)
    elif args.command == "check":
        found = engine.check().collect()  # a row a broken constraint
        for r in found:
            print(f"{r['table']}: {r['problem']}")
        if found:
            raise SqlError(f"{len(found)} problems")
        print("ok")
    elif args.command == "checkpoint":
        print(f"{engine.store.vacuum()} folders deleted")
    elif args.command == "schema":
        print(engine.schema(args.table))
    elif args.command == "query":
        for out in engine.script(args.sql):
            show(out) if isinstance(out, DataFrame) else print(f"{out.count} rows")
    elif args.command == "dump":
        print(";\n".join(dump(engine)))
    elif args.command == "restore":
        with open(args.file, encoding="utf-8") as f:
            restore(engine, f.read())
    elif args.command == "import":
        print(f"{import_csv(engine, args.file, args.table).count} rows")
    else:
        df = engine.table(args.table)
        show({"stats": analytics.stats, "sample": lambda d: analytics.sample(d, args.n), "profile": lambda d: analytics.profile(d, args.top)}[args.command](df))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        _run(args, spark or SparkSession.builder.getOrCreate())
    except (SqlError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
