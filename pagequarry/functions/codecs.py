"""Stream codecs and decryption as Catalyst expressions, and chains that mix them with the scan's own codecs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.sources import codecs, security
from pagequarry.sources.document import DEFAULT_MAX_STREAM
from pagequarry.sources.syntax import PdfError
from pagequarry.workspace import ship, stage_rows

#: Filters that are expressions, with their abbreviations (fixed values).
HEX, RUN_LENGTH = ("ASCIIHexDecode", "AHx"), ("RunLengthDecode", "RL")
_PARAMS = "struct<predictor:int,columns:int,colors:int,bpc:int,no_early_change:boolean>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it (a bound variable is not written out again)."""
    return F.transform(F.array(value), body)[0]


def ascii_hex(raw: Column) -> Column:
    """Hexadecimal digits up to ``>``, white space between them ignored; null on anything else."""
    even = lambda digits: F.concat(digits, F.when(F.length(digits) % 2 == 1, F.lit("0")).otherwise(F.lit("")))
    digits = F.translate(F.substring_index(F.decode(raw, "ISO-8859-1"), ">", 1), " \t\r\n\f", "")
    return let(digits, lambda found: F.when(~found.rlike("[^0-9A-Fa-f]"), F.unhex(even(found))))


def _run_pattern() -> str:
    """One run after the other: a length and as many bytes, a length and the byte it repeats, or the end and all behind it."""
    literal = "|".join(rf"\x{n:02x}.{{{n + 1}}}" for n in range(128))
    return rf"(?s)\G(?:[\x81-\xff].|{literal}|\x80.*)"


def run_length(raw: Column) -> Column:
    """Runs of single bytes and of literal ones up to the end mark; null if a run is cut off."""
    size = F.ascii  # of the first character, which is the length byte
    one = lambda r: let(size(r), lambda n: F.when(n < 128, F.substr(r, F.lit(2))).when(n > 128, F.repeat(F.substr(r, F.lit(2)), F.lit(257) - n)).otherwise(F.lit("")))
    whole = lambda text, runs: F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r)) == F.length(text)
    joined = lambda text, runs: F.when(whole(text, runs), F.encode(F.array_join(F.transform(runs, one), ""), "ISO-8859-1"))
    found = lambda text: let(F.regexp_extract_all(text, F.lit(_run_pattern()), F.lit(0)), lambda runs: joined(text, runs))
    return let(F.decode(raw, "ISO-8859-1"), found)


def native_chain(raw: Column, filters: Column, most: int = DEFAULT_MAX_STREAM) -> Column:
    """What a chain's filters give as far as they are expressions: struct of data, number of filters done, and error."""
    start = F.struct(raw.alias("data"), F.lit(0).alias("done"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, name: Column) -> Column:
        native = name.isin(*HEX, *RUN_LENGTH) & acc["error"].isNull()

        def after(data: Column) -> Column:
            over = name.isin(*RUN_LENGTH) & F.lit(most > 0) & (F.octet_length(data) > most)
            error = F.when(data.isNull(), F.concat(name, F.lit(": bad data"))).when(over, F.lit(f"decoded output exceeds limit of {most} bytes"))
            return F.struct(F.when(error.isNull(), data).alias("data"), (acc["done"] + 1).alias("done"), error.alias("error"))

        data = F.when(name.isin(*HEX), ascii_hex(acc["data"])).otherwise(run_length(acc["data"]))
        return F.when(native, let(data, after)).otherwise(acc)

    # filters after the first one that is no expression are left to it
    ahead = F.coalesce(F.array_min(F.transform(filters, lambda f, k: F.when(~f.isin(*HEX, *RUN_LENGTH), k))), F.size(filters))
    return F.aggregate(F.slice(filters, F.lit(1), ahead), start, step)


def decode_streams(streams: DataFrame, most: int = DEFAULT_MAX_STREAM) -> DataFrame:
    """``streams`` (raw, filters, params) with decoded and error: expressions first, the scan's codecs for the rest of a chain.

    Streams whose filters are all expressions never reach a Python worker.
    """
    own = streams.drop("decoded", "error").withColumn("chain", native_chain(F.col("raw"), F.coalesce("filters", F.array().cast("array<string>")), most))
    # stored: what comes after names the chain many times, and each would decode again
    own = stage_rows(own, "chains")
    left = F.slice("filters", F.col("chain.done") + 1, F.size("filters") - F.col("chain.done"))
    own = own.withColumn("rest", F.when(F.col("chain.error").isNull(), left).otherwise(F.array().cast("array<string>")))
    names = [c for c in streams.columns if c not in ("decoded", "error")]
    done = own.where(F.size("rest") <= 0).select(*names, F.col("chain.data").alias("decoded"), F.col("chain.error").alias("error"))
    later = own.where(F.size("rest") > 0).select(*names, F.col("chain.data").alias("decoded"), "rest", F.slice("params", F.col("chain.done") + 1, F.size("rest")).alias("given"))
    return done.unionByName(_kernel_chain(later, names, most))


def _kernel_chain(rows: DataFrame, names: list[str], most: int) -> DataFrame:
    ship(rows.sparkSession)
    schema = rows.select(*names, "decoded", F.lit(None).cast("string").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, errors = [], []
            for raw, chain, given in zip(batch.column("decoded").to_pylist(), batch.column("rest").to_pylist(), batch.column("given").to_pylist(), strict=True):
                error = None
                try:
                    for name, p in zip(chain, given, strict=True):
                        raw = codecs.decode(name, raw, codecs.Params(p["predictor"], p["columns"], p["colors"], p["bpc"], not p["no_early_change"]), most)
                except PdfError as e:
                    raw, error = None, str(e)
                data.append(raw)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(data, pa.binary()), pa.array(errors, pa.string())], names=[*names, "decoded", "error"])

    return rows.mapInArrow(run, schema)


# --- decryption -------------------------------------------------------------


def little_endian(number: Column, n_bytes: int) -> Column:
    """The lowest bytes of a number, lowest first."""
    digits = F.lpad(F.hex(number.bitwiseAND(F.lit((1 << 8 * n_bytes) - 1))), 2 * n_bytes, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(n_bytes, 0, -1)]))


def object_key(file_key: Column, num: Column, gen: Column, aes: Column) -> Column:
    """The key of one object's streams under RC4 or 128-bit AES."""
    salt = F.when(aes, F.lit(b"sAlT")).otherwise(F.lit(b""))
    digest = F.unhex(F.md5(F.concat(file_key, little_endian(num, 3), little_endian(gen, 2), salt)))
    return F.substr(digest, F.lit(1), F.least(F.octet_length(file_key) + 5, F.lit(16)))


def decrypt_streams(streams: DataFrame, keys: DataFrame) -> DataFrame:
    """``streams`` (doc_id, num, gen, raw) with raw decrypted by the keys of table ``security``, and error.

    AES with proper padding is done in the JVM; what its padding rules refuse, and RC4,
    goes through vectorised code, these rows alone.
    """
    joined = streams.join(keys.select("doc_id", "cipher", "file_key"), "doc_id", "left")
    aes = F.col("cipher").isin("aes128", "aes256")
    key = F.when(F.col("cipher") == "aes256", F.col("file_key")).otherwise(object_key(F.col("file_key"), F.col("num"), F.col("gen"), aes))
    joined = joined.withColumn("key", key).withColumn("plain", F.when(aes & (F.octet_length("raw") >= 32), F.try_aes_decrypt("raw", "key", F.lit("CBC"), F.lit("PKCS"))))
    as_is = F.col("cipher").isNull() | (F.col("cipher") == "identity")
    held = stage_rows(joined.withColumn("plain", F.when(as_is, F.col("raw")).otherwise(F.col("plain"))), "decrypted")
    names = streams.columns
    out = [F.col("plain").alias("raw") if c == "raw" else F.col(c) for c in names]
    done = held.where("plain is not null or raw is null").select(*out, F.lit(None).cast("string").alias("error"))
    return done.unionByName(_lenient(held.where("plain is null and raw is not null"), names))


def _lenient(rows: DataFrame, names: list[str]) -> DataFrame:
    ship(rows.sparkSession)
    schema = rows.select(*names, F.lit(None).cast("string").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, errors = [], []
            for raw, key, cipher in zip(batch.column("raw").to_pylist(), batch.column("key").to_pylist(), batch.column("cipher").to_pylist(), strict=True):
                try:
                    data.append(security.rc4(key, raw) if cipher == "rc4" else security.aes_stream(key, raw))
                    errors.append(None)
                except PdfError as e:
                    data.append(None)
                    errors.append(str(e))
            columns = [pa.array(data, pa.binary()) if c == "raw" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], names=[*names, "error"])

    return rows.select(*names, "key", "cipher").mapInArrow(run, schema)
