"""A store from the command line: python -m kvlake PATH get KEY | put KEY VALUE | delete KEY | iter [--low K] [--high K] [--reverse] | compact [--low K] [--high K] | recover LOGS."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from kvlake.sources.store import Options, Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kvlake", description="Read and change a store.")
    out.add_argument("path", help="folder of the store, on any file system that Spark reads")
    out.add_argument("--create", action="store_true", help="make the store if it isn't there")
    what = out.add_subparsers(dest="what", required=True)
    for name, keys in (("get", ["key"]), ("put", ["key", "value"]), ("delete", ["key"]), ("recover", ["logs"]), ("iter", []), ("compact", [])):
        sub = what.add_parser(name)
        for key in keys:
            sub.add_argument(key)
        if name in ("iter", "compact"):
            sub.add_argument("--low")
            sub.add_argument("--high")
        if name == "iter":
            sub.add_argument("--reverse", action="store_true")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 where a key that is asked for isn't there."""
    told = parser().parse_args(argv)
    store = Store(spark or SparkSession.builder.appName("kvlake").getOrCreate(), told.path, Options(create_if_missing=told.create))
    if told.what == "get":
        value = store.get(told.key)
        if value is None:
            print(f"{told.key}: not found", file=sys.stderr)
            return 1
        print(value)
    elif told.what == "put":
        store.put(told.key, told.value)
    elif told.what == "delete":
        store.delete(told.key)
    elif told.what == "recover":
        print(store.recover(told.logs))
    elif told.what == "iter":
        for row in store.scan(told.low, told.high, reverse=told.reverse).toLocalIterator():
            print(f"{row['k']} => {row['v']}")
    else:
        store.compact(told.low, told.high)
    return 0


if __name__ == "__main__":
    sys.exit(main())
