"""Scalar functions over PDF values as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.operators.dump import document_encoding


def _first_bytes(raw: Column, n: int) -> Column:
    return F.hex(F.substring(raw, 1, n))


def decode_document_encoding(raw: Column) -> Column:
    """Bytes in document encoding, undefined ones replaced."""
    table = {k: v for k, v in document_encoding().items() if v != chr(k)}
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, table)), "".join(table.values()))


def decode_utf16(raw: Column, little: bool = False) -> Column:
    """UTF-16 without its mark; a last odd byte is dropped, lone surrogates are replaced."""
    units = F.regexp_extract_all(F.hex(raw), F.lit("([0-9A-F]{4})"), F.lit(1))
    if little:
        units = F.transform(units, lambda u: F.concat(F.substring(u, 3, 2), F.substring(u, 1, 2)))
    high, low = lambda u: F.coalesce(u.rlike("^D[89AB]"), F.lit(False)), lambda u: F.coalesce(u.rlike("^D[CDEF]"), F.lit(False))

    def mended(us: Column) -> Column:
        def one(u: Column, k: Column) -> Column:
            before, after = F.when(k > 0, F.get(us, k - 1)), F.get(us, k + 1)
            return F.when((high(u) & ~low(after)) | (low(u) & ~high(before)), F.lit("FFFD")).otherwise(u)

        return F.transform(us, one)

    joined = F.array_join(F.transform(F.array(units), mended)[0], "")
    # without a surrogate there is nothing to mend; looked for where units begin, so that it is not two halves of other units
    plain = (F.octet_length(raw) % 2 == 0) & ~F.hex(raw).rlike("^(?:.{4})*.{2}D[89A-F]" if little else "^(?:.{4})*D[89A-F]")
    return F.when(plain, F.decode(raw, "UTF-16LE" if little else "UTF-16BE")).otherwise(F.decode(F.unhex(joined), "UTF-16BE"))


def decode_text(raw: Column) -> Column:
    """A text string by its byte order mark, or in document encoding."""
    rest = lambda n: F.substr(raw, F.lit(n), F.greatest(F.octet_length(raw) - (n - 1), F.lit(0)))
    return (
        F.when(_first_bytes(raw, 2) == "FEFF", decode_utf16(rest(3)))
        .when(_first_bytes(raw, 2) == "FFFE", decode_utf16(rest(3), little=True))
        .when(_first_bytes(raw, 3) == "EFBBBF", F.make_valid_utf8(rest(4).cast("string")))
        .otherwise(decode_document_encoding(raw))
    )


_DATE = r"^(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([+\-])(\d{2})?'?(\d{2})?)?"


def _date_part(text: Column, group: int, default: int) -> Column:
    found = F.regexp_extract(text, _DATE, group)
    return F.when(found != "", found.cast("int")).otherwise(F.lit(default))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "^D:", "")


def date_offset(text: Column) -> Column:
    """Seconds east of Greenwich of a date string; null where there is no date."""
    text = _trimmed(text)
    size = _date_part(text, 8, 0) * 3600 + _date_part(text, 9, 0) * 60
    signed = F.when(F.regexp_extract(text, _DATE, 7) == "-", -size).when(F.regexp_extract(text, _DATE, 7) == "+", size).otherwise(F.lit(0))
    return F.when(_valid_date(text), signed)


def _valid_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}") & _date_part(text, 2, 1).between(1, 12) & _date_part(text, 3, 1).between(1, 31)


def parse_date(text: Column) -> Column:
    """The instant of a date string; later fields may overflow, missing ones have defaults."""
    own = _trimmed(text)
    part = lambda g, d: _date_part(own, g, d)
    month = F.when(_valid_date(own), F.make_timestamp(part(1, 1), part(2, 1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    return month + F.make_dt_interval(part(3, 1) - 1, part(4, 0), part(5, 0), (part(6, 0) - date_offset(text)).cast("decimal(18,6)"))


def looks_like_text(raw: Column) -> Column:
    """Whether a string is text rather than binary."""
    marked = _first_bytes(raw, 2).isin("FEFF", "FFFE") | (_first_bytes(raw, 3) == "EFBBBF")
    plain = F.decode(raw, "ISO-8859-1")
    return marked | (~plain.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]") & ~F.contains(decode_document_encoding(raw), F.lit("�")))


def preview(raw: Column, most: int = 80) -> Column:
    """The first bytes if they are printable, else nothing."""
    head = F.decode(F.substring(raw, 1, most), "ISO-8859-1")
    shown = F.concat(head, F.when(F.octet_length(raw) > most, F.lit("…")).otherwise(F.lit("")))
    return F.when(head.rlike(r"[^\t\r\n\x20-\x7e]"), F.lit("")).otherwise(shown)


def operand_int(literal: Column) -> Column:
    """The integer an operand is written as, or null."""
    return F.when(~literal.rlike(r"[.eE]"), literal.try_cast("bigint"))


def normal_rect(numbers: Column) -> Column:
    """A rectangle from four numbers in any corner order, or null."""
    n = lambda k: F.get(numbers, k)
    whole = (F.size(numbers) == 4) & F.forall(numbers, lambda x: x.isNotNull())
    fields = [F.least(n(0), n(2)).alias("llx"), F.least(n(1), n(3)).alias("lly"), F.greatest(n(0), n(2)).alias("urx"), F.greatest(n(1), n(3)).alias("ury")]
    return F.when(whole, F.struct(*[f for f in fields]))


def normal_rotation(kind: Column, degrees: Column) -> Column:
    """Clockwise degrees from 0 to 270; what is no multiple of 90 counts as 0."""
    turned = F.pmod(degrees, F.lit(360))
    return F.when((kind == "int") & (turned % 90 == 0), turned).otherwise(F.lit(0)).cast("int")
