"""Command line: ``python -m kolonna insert TABLE FILES…`` loads files, ``python -m kolonna shell`` starts a console."""

from __future__ import annotations

import argparse
import atexit
import importlib
import os

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kolonna")
    top.add_argument("-w", "--warehouse", help="folder of the stored tables")
    verbs = top.add_subparsers(dest="verb", required=True)
    load = verbs.add_parser("insert", help="append files to a table")
    load.add_argument("table")
    load.add_argument("files", nargs="*")
    load.add_argument("-f", "--infile", help="a file that lists the files, one a line")
    load.add_argument("-p", "--preprocess", help="module.function applied to each record")
    load.add_argument("--csv-fields", help="the files are delimited; the names of their values, between commas")
    load.add_argument("--delimiter", default=",")
    load.add_argument("--header", action="store_true", help="leave out the first line of each file")
    load.add_argument("-m", "--maxsize", type=int, help="bytes of a written file at most, about; a larger partition becomes several files")
    load.add_argument("-t", "--tmpdir", help="shared folder for intermediate files (spark.checkpoint.dir)")
    load.add_argument("-s", "--server", help="the Spark master to run on")
    load.add_argument("--partition", action="append", help="load only this partition value (may be repeated)")
    verbs.add_parser("shell", help="a console with the tables and the query language")
    return top


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    builder = SparkSession.builder.appName("kolonna").config("spark.sql.session.timeZone", "UTC")
    if getattr(given, "server", None):
        builder = builder.master(given.server)
    spark = builder.getOrCreate()
    if getattr(given, "tmpdir", None):
        spark.conf.set("spark.checkpoint.dir", given.tmpdir if "://" in given.tmpdir else f"file://{os.path.abspath(given.tmpdir)}")
    if getattr(given, "maxsize", None):
        # rebalanced partitions are split at this size before they are written
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", given.maxsize)
    from kolonna.catalog import Catalog
    from kolonna.settings import overrides

    if given.warehouse:
        overrides["warehouse"] = given.warehouse
    return load(spark, given) if given.verb == "insert" else shell(Catalog(spark))


def load(spark: SparkSession, given: argparse.Namespace) -> int:
    from kolonna.catalog import Catalog
    from kolonna.sources.decoders import csv_decoder
    from kolonna.sources.ingest import insert

    files = list(given.files)
    if given.infile:
        with open(given.infile) as f:
            files += [line.strip() for line in f if line.strip()]
    preprocess = None
    if given.preprocess:
        module, _, function = given.preprocess.rpartition(".")
        preprocess = getattr(importlib.import_module(module), function)
    decoder = csv_decoder(given.csv_fields.split(","), given.delimiter) if given.csv_fields else None
    done = insert(Catalog(spark).open(given.table), files, decoder=decoder, preprocess=preprocess, header=given.header, partition_filter=given.partition)
    print(f"{done.table}: {done.rows:,} rows in {len(done.files):,} files, {done.rejected:,} lines rejected")
    return 0


def keep_history(readline, path: str | None = None) -> None:
    """Read the lines of former consoles, and write those of this one at its end, up to the setting ``history``."""
    from kolonna.settings import Settings

    path = path or os.path.expanduser("~/.kolonna_history")
    readline.set_history_length(Settings.of().history)
    if os.path.exists(path):
        readline.read_history_file(path)
    atexit.register(readline.write_history_file, path)


def shell(catalog) -> int:
    import code
    import rlcompleter

    import kolonna.api as api

    names = {n: getattr(api, n) for n in api.__all__} | {n: catalog.open(n) for n in catalog.names() if n.isidentifier()} | {"spark": catalog.spark}
    names["commands"] = lambda: print("\n".join(sorted(api.__all__)))
    try:
        import readline

        readline.set_completer(rlcompleter.Completer(names).complete)
        readline.parse_and_bind("tab: complete")
        keep_history(readline)
    except ImportError:
        pass
    code.interact(banner=f"tables: {', '.join(catalog.names()) or 'none'}; commands() lists the language", local=names, exitmsg="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
