"""Column expressions over BINARY values; all stay inside code generation.

Spark has no unsigned types: amounts and offsets of 64 bits are DECIMAL(20,0), short channel ids keep their 64-bit pattern in
a BIGINT, and everything shorter is a BIGINT. A slice that is shorter than asked gives NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"
NUL = "\x00"


def _at(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def cut(b: Column, pos: int | Column, n: int | Column) -> Column:
    """``n`` bytes from 1-based ``pos``, or NULL if fewer are there."""
    pos, n = _at(pos).cast("int"), _at(n).cast("int")
    return F.when(F.length(b) >= pos + n - 1, F.substring(b, pos, n))


def tail(b: Column, pos: int) -> Column:
    """The bytes from 1-based ``pos`` on."""
    return F.substring(b, pos, 2**31 - 1)


def hex_lower(b: Column) -> Column:
    return F.lower(F.hex(b))


def u64(b: Column, pos: int | Column = 1) -> Column:
    """8 bytes, big-endian, as DECIMAL(20,0)."""
    return F.conv(F.hex(cut(b, pos, 8)), 16, 10).cast(U64)


def uint(b: Column, pos: int | Column = 1, n: int = 4) -> Column:
    """1 to 7 bytes, big-endian, as BIGINT."""
    return F.conv(F.hex(cut(b, pos, n)), 16, 10).cast("long")


def bits64(b: Column, pos: int | Column = 1) -> Column:
    """8 bytes, big-endian, as the same bits in a BIGINT."""
    high, low = uint(b, pos, 4), uint(b, _at(pos) + 4, 4)
    return F.shiftleft(high, 32).bitwiseOR(low)


def flag(b: Column, bit: int = 0) -> Column:
    """One bit of a one-byte value, as INT."""
    return F.shiftright(uint(b, 1, 1), bit).bitwiseAND(F.lit(1)).cast("int")


def reversed_hex(b: Column) -> Column:
    """Hex of the bytes in reverse order. (``reverse`` on BINARY reverses UTF-8 characters.)"""
    return F.array_join(F.reverse(F.regexp_extract_all(hex_lower(b), F.lit("(..)"), F.lit(1))), "")


def reversed_bytes(b: Column) -> Column:
    return F.unhex(reversed_hex(b))


def bytes_of(value: Column, n: int) -> Column:
    """``n`` big-endian bytes of a non-negative integer column or, for 8 bytes, of any BIGINT bit pattern or DECIMAL(20,0)."""
    return F.unhex(F.lpad(F.conv(value.cast("string"), 10, 16), 2 * n, "0"))


def scid_text(scid: Column) -> Column:
    """A short channel id as block x transaction x output: 24, 24 and 16 bits."""
    block = F.shiftrightunsigned(scid, 40).bitwiseAND(F.lit(0xFFFFFF).cast("long"))
    transaction = F.shiftrightunsigned(scid, 16).bitwiseAND(F.lit(0xFFFFFF).cast("long"))
    return F.concat_ws("x", block.cast("string"), transaction.cast("string"), scid.bitwiseAND(F.lit(0xFFFF).cast("long")).cast("string"))


def scid_of(text: Column) -> Column:
    """The BIGINT behind ``block x transaction x output``; NULL if the text is none."""
    part = lambda i: F.regexp_extract(text, r"^(\d{1,8})x(\d{1,8})x(\d{1,5})$", i).try_cast("long")
    return F.shiftleft(part(1), 40).bitwiseOR(F.shiftleft(part(2), 16)).bitwiseOR(part(3))


def varint_width(first: Column) -> Column:
    """Bytes behind the first byte of a variable-length integer."""
    return F.when(first < 0xFD, 0).when(first == 0xFD, 2).when(first == 0xFE, 4).otherwise(8)


def varint_decode(b: Column, big_endian: bool = False) -> Column:
    """The variable-length integer that ``b`` begins with, as DECIMAL(20,0); NULL if it is empty or cut short."""
    first = uint(b, 1, 1)
    body = cut(b, 2, varint_width(first))
    digits = F.hex(body) if big_endian else reversed_hex(body)
    return F.when(first < 0xFD, first.cast(U64)).otherwise(F.conv(digits, 16, 10).cast(U64))


def varint_encode(value: Column) -> Column:
    """The little-endian variable-length integer of 0 to 2**64 - 1; any other value is an error."""
    v = value.cast("decimal(38,0)")
    body = lambda n: reversed_bytes(F.unhex(F.lpad(F.conv(v.cast("string"), 10, 16), 2 * n, "0")))
    marked = lambda mark, n: F.concat(F.unhex(F.lit(mark)), body(n))
    return (
        F.when(v.isNull(), F.lit(None).cast("binary"))
        .when((v < 0) | (v > F.lit("18446744073709551615").cast("decimal(38,0)")), F.raise_error(F.lit("varint out of range")).cast("binary"))
        .when(v < 0xFD, body(1)).when(v <= 0xFFFF, marked("fd", 2)).when(v <= 0xFFFFFFFF, marked("fe", 4)).otherwise(marked("ff", 8))
    )


def base32(b: Column) -> Column:
    """RFC 4648 base32 in lower case without padding."""
    padded = F.concat(b, F.unhex(F.lit("00")))
    pair = lambda i: F.conv(F.hex(F.substring(padded, F.floor(i * 5 / 8).cast("int") + 1, F.lit(2))), 16, 10).cast("int")
    shift = lambda i: 11 - (i * 5) % 8
    five = lambda i: F.floor(pair(i) / F.pow(F.lit(2), shift(i))).cast("int").bitwiseAND(F.lit(31))
    n = F.ceil(F.length(b) * 8 / 5).cast("int")
    letters = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz234567"), five(i) + 1, F.lit(1)))
    return F.when(F.length(b) == 0, F.lit("")).otherwise(F.array_join(letters, ""))


def alias_strict(b: Column) -> Column:
    """A node's alias without NULs at either end, or hex of all its bytes where they are not UTF-8."""
    text = b.cast("string")
    return F.when(F.is_valid_utf8(text), F.btrim(text, F.lit(NUL))).otherwise(hex_lower(b))


def alias_lossy(b: Column) -> Column:
    """A node's alias without NULs at its end and without what is not UTF-8."""
    text = b.cast("string")
    valid = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
    return F.regexp_replace(valid, "\\x00+$", "")


def gossip_id(message: Column) -> Column:
    """The SHA-256 of a raw message, in hex."""
    return F.sha2(message, 256)


def store_version(first: Column) -> Column:
    """The upper three bits of a store's version byte."""
    return F.shiftright(uint(first, 1, 1), 5).bitwiseAND(F.lit(7)).cast("int")


def iso_time(seconds: Column) -> Column:
    """Epoch seconds as ISO 8601 text in UTC, without a zone."""
    whole = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss")
