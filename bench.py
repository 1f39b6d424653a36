"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Decoding and three scans of page files are timed on files that are built and stored
beforehand, each next to a single process that runs the same kernel without Spark.
"""

from __future__ import annotations

import json
import os
import sys
import time
import zlib

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["q01_doc_info", "q02_flate", "q11_unicode_text", "q15_page_tree", "q16_boxes", "q19_page_content", "q22_object_stream", "q28_marked_content", "q32_dump", "q34_diff"]


def timed(action) -> float:
    began = time.perf_counter()
    action()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pagequarry.plans import queries as Q
    from pagequarry.sources.scan import ScanOptions, rows_of, scan
    from pagequarry.testing import pdfwriter as P
    from pagequarry.workspace import stage

    done = lambda df: df.write.format("noop").mode("overwrite").save()
    done(Q.QUERIES["q32_dump"](spark, SF_DIR))  # starts workers
    times = {name: timed(lambda: done(Q.QUERIES[name](spark, SF_DIR))) for name in HEADLINE}  # noqa: B023

    files = stage(Q._text_files(spark, SF_DIR, lambda t: P.stream(zlib.compress(t), b"/Filter /FlateDecode")), "bench").repartition(int(CPUS)).persist()
    n = files.count()
    times["decode_stored"] = timed(lambda: done(scan(files, "streams")))
    held = [bytes(r[0]) for r in files.select("content").limit(2_000).collect()]
    decoded = 0

    def single() -> None:
        nonlocal decoded
        for content in held:
            decoded += sum(len(row[7]) for row in rows_of("streams", content, ScanOptions()))

    alone = timed(single)
    pages = stage(Q._page_files(spark, SF_DIR, lambda x: b"/MediaBox [%s 0 -1.5 7]" % repr(x["l_quantity"]).encode()), "bench-pages").repartition(int(CPUS)).persist()
    n_pages = pages.count()
    kept = [bytes(r[0]) for r in pages.select("content").limit(2_000).collect()]
    scans = {}
    for name, table, columns in (("page_count", "documents", ("page_count",)), ("boxes", "page_spine", ("page_index", "attributes")), ("objects", "nodes", None)):
        wall = times[f"scan_{name}"] = timed(lambda: done(scan(pages, table, columns=columns)))  # noqa: B023
        one = timed(lambda: [list(rows_of(table, content, ScanOptions(columns=columns))) for content in kept])  # noqa: B023
        scans[name] = {"files": n_pages, "spark_files_s": round(n_pages / wall, 1), "single_files_s": round(len(kept) / one, 1)}

    rate = {"files": n, "spark_files_s": round(n / times["decode_stored"], 1), "single_files_s": round(len(held) / alone, 1), "single_mb_s": round(decoded / 1e6 / alone, 2)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "decode": rate, "scans": scans}))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
