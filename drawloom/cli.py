"""Console commands over the entries table."""

from __future__ import annotations

import argparse
import sys

from .config import Settings, configure_logging


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="drawloom", description="Manage local entries.")
    commands = top.add_subparsers(dest="command")
    for name, text in (("init-db", "Create the table."), ("add", "Add an entry."), ("list", "List entries, newest first."), ("config", "Show the settings.")):
        own = commands.add_parser(name, help=text)
        if name == "add":
            own.add_argument("message")
        if name != "config":
            own.add_argument("--database", "-d", default=None, help="Another path of the table.")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if not args.command:
        top.print_help()
        return 0
    settings = Settings.from_environment()
    if args.command == "config":
        print(f"data_dir={settings.data_dir}\ndatabase_path={settings.database_path}\nlog_level={settings.log_level}")
        return 0
    from pyspark.sql import SparkSession

    from .sources.entries import EntryStore

    configure_logging(settings.log_level)
    spark = spark or SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    store = EntryStore(spark, args.database or str(settings.database_path))
    if args.command == "init-db":
        store.initialize()
        print(f"Initialized database: {store.path}")
    elif args.command == "add":
        row = store.add_entry(args.message)
        print(f"Added entry {row.id}: {row.message}")
    else:
        for row in store.list_entries():
            print(f"{row.id}\t{row.created_at}\t{row.message}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
