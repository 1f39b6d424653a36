"""Every query against its SQL on the smallest tables, and the expressions on their own."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagequarry.functions import text as T
from pagequarry.operators.dump import decode_text
from pagequarry.plans.registry import ORACLE, QUERIES
from pagequarry.sources.scan import read_files
from pagequarry.testing import pdfwriter as P

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    expected = con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    key = lambda d: sorted((tuple(None if v is None or v != v else v for v in r) for r in d[sorted(d.columns)].astype(object).values.tolist()), key=str)
    assert key(got) == key(expected)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)


def test_text_expressions_agree_with_the_kernel(spark):
    cases = [b"", b"plain", b"A\x18\x80\xa0\xe9\x7f\x9f\x00\xad", b"\xfe\xff", b"\xfe\xff\x00A\xd8\x3d\xde\x00", b"\xfe\xff\xd8\x3d\x00A", b"\xfe\xff\xde\x00\xde\x00", b"\xff\xfeA\x00\x3d\xd8\x00\xde\x01", b"\xef\xbb\xbfh\xc3\xa9"]
    rows = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)], "k int, raw binary")
    got = {r["k"]: r["t"] for r in rows.select("k", T.decode_text(F.col("raw")).alias("t")).collect()}
    assert got == {k: decode_text(c) for k, c in enumerate(cases)}


def test_dates(spark):
    cases = {
        "D:20240102030405Z": (1704164645, 0), "D:2024": (1704067200, 0), "20240102": (1704153600, 0), "D:20240102030405+05'30'": (1704144845, 19800),
        "D:20240230": (1709251200, 0), "D:202413": (None, None), "junk": (None, None), "": (None, None), " D:2024-01 ": (1704070800, -3600),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: (r["t"], r["o"]) for r in rows.select("s", F.unix_timestamp(T.parse_date(F.col("s"))).alias("t"), T.date_offset(F.col("s")).alias("o")).collect()}
    assert got == cases


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(P.page_file([(b"", [b"q"])]))
    (tmp_path / "b.txt").write_bytes(b"no")
    files = read_files(spark, str(tmp_path))
    assert files.count() == 1 and files.select("length").first()[0] > 0


def test_operand_integers(spark):
    rows = spark.createDataFrame([("12",), ("1.0",), ("-3",), ("99999999999999999999",), ("+",)], "s string")
    assert [r[0] for r in rows.select(T.operand_int(F.col("s"))).collect()] == [12, None, -3, None, None]
