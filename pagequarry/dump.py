"""Command line: ``python -m pagequarry.dump [--stream-content] [--no-preview] PATH`` prints each file's snapshot as JSON.

``PATH`` is a file or a folder that Spark can read; with ``--out`` each snapshot becomes a
file there, named after its document, instead of being printed.  Files that cannot
be read are named on the error stream, and the command returns 1.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from pagequarry.operators.dump import DumpOptions
from pagequarry.sources.datasource import register
from pagequarry.sources.scan import ScanOptions, read_files, scan
from pagequarry.workspace import stage


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pagequarry.dump", description=__doc__)
    out.add_argument("path")
    out.add_argument("--stream-content", "-stream-content", action="store_true", help="decoded streams in full, as hex")
    out.add_argument("--no-preview", "-no-preview", action="store_true", help="no beginnings of decoded streams")
    out.add_argument("--password", default="")
    out.add_argument("--glob", default="*.pdf")
    out.add_argument("--out", help="folder for the snapshots")
    return out


def main(argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pagequarry.dump").getOrCreate()
    look = DumpOptions(preview=-1 if given.no_preview else DumpOptions().preview, inline=given.stream_content)
    options = ScanOptions(password=given.password.encode(), dump=look, open_errors=True)
    files = read_files(spark, given.path, given.glob)
    snapshots = scan(files, "dumps", options)
    if given.out:
        snapshots = stage(snapshots, "dumps")
        register(spark)
        snapshots.where("error is null").select("doc_id", "json").write.format("pagequarry").option("suffix", ".json").mode("append").save(given.out)
        snapshots = snapshots.where("error is not null")
    failed = 0
    for row in snapshots.toLocalIterator():
        if row["error"] is None:
            print(row["json"], end="")
        else:
            print(f"{row['doc_id']}: {row['error']}", file=sys.stderr)
            failed = 1
    return failed


if __name__ == "__main__":
    sys.exit(main())
