"""Everything by name in SQL: functions over binary columns, a table function for addresses, and a view for each kind of message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gossamer.functions.addresses import ParseAddresses
from gossamer.operators.decode import decode, tagged
from gossamer.schemas import KIND_NAMES

# Spark inlines these, so they stay native expressions.
_SQL_FUNCTIONS = {
    "message_tag": ("b BINARY", "INT", "CASE WHEN length(b) >= 2 THEN CAST(conv(hex(substring(b, 1, 2)), 16, 10) AS INT) END"),
    "uint_be": ("b BINARY", "DECIMAL(20,0)", "CAST(conv(hex(b), 16, 10) AS DECIMAL(20,0))"),
    "reverse_bytes": ("b BINARY", "BINARY", "unhex(array_join(reverse(regexp_extract_all(lower(hex(b)), '(..)', 1)), ''))"),
    "scid_text": ("s BIGINT", "STRING", "concat_ws('x', CAST(shiftrightunsigned(s, 40) & 16777215 AS STRING), CAST(shiftrightunsigned(s, 16) & 16777215 AS STRING), CAST(s & 65535 AS STRING))"),
    "alias_strict": ("b BINARY", "STRING", "CASE WHEN is_valid_utf8(CAST(b AS STRING)) THEN trim(BOTH '\\0' FROM CAST(b AS STRING)) ELSE lower(hex(b)) END"),
    "alias_lossy": ("b BINARY", "STRING", "regexp_replace(CASE WHEN is_valid_utf8(CAST(b AS STRING)) THEN CAST(b AS STRING) ELSE replace(make_valid_utf8(CAST(b AS STRING)), '�', '') END, '\\\\x00+$', '')"),
    "scid_of": ("t STRING", "BIGINT", "shiftleft(CAST(split(t, 'x')[0] AS BIGINT), 40) | shiftleft(CAST(split(t, 'x')[1] AS BIGINT), 16) | CAST(split(t, 'x')[2] AS BIGINT)"),
    "varint_width": ("b BINARY", "INT", "coalesce(try_element_at(map('fd', 3, 'fe', 5, 'ff', 9), lower(hex(substring(b, 1, 1)))), CASE WHEN length(b) > 0 THEN 1 END)"),
    "varint_decode": ("b BINARY", "DECIMAL(20,0)", "CASE WHEN length(b) >= varint_width(b) THEN CASE varint_width(b) WHEN 1 THEN uint_be(substring(b, 1, 1)) ELSE uint_be(reverse_bytes(substring(b, 2, varint_width(b) - 1))) END END"),
    "varint_encode": ("n BIGINT", "BINARY", "CASE WHEN n < 0 THEN NULL WHEN n < 253 THEN unhex(lpad(hex(n), 2, '0')) WHEN n < 65536 THEN concat(unhex('fd'), reverse_bytes(unhex(lpad(hex(n), 4, '0')))) WHEN n < 4294967296 THEN concat(unhex('fe'), reverse_bytes(unhex(lpad(hex(n), 8, '0')))) ELSE concat(unhex('ff'), reverse_bytes(unhex(lpad(hex(n), 16, '0')))) END"),
    "base32_text": ("b BINARY", "STRING", "array_join(transform(regexp_extract_all(rpad(array_join(transform(regexp_extract_all(lower(hex(b)), '(.)', 1), c -> lpad(conv(c, 16, 2), 4, '0')), ''), CAST(5 * ceil(length(b) * 8 / 5.0) AS INT), '0'), '(.....)', 1), v -> substring('abcdefghijklmnopqrstuvwxyz234567', CAST(conv(v, 2, 10) AS INT) + 1, 1)), '')"),
    "gossip_id": ("b BINARY", "STRING", "sha2(b, 256)"),
    "update_direction": ("b BINARY", "INT", "CAST(conv(hex(substring(b, 1, 1)), 16, 10) AS INT) & 1"),
    "address_type": ("t INT", "STRING", "coalesce(try_element_at(map(1, 'IPv4', 2, 'IPv6', 3, 'Torv2', 4, 'Torv3', 5, 'DNS'), t), 'Unknown')"),
}


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions, and ``parse_addresses`` as a table function."""
    for name, (argument, result, body) in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURNS {result} RETURN {body}")
    spark.udtf.register("parse_addresses", ParseAddresses)


def create_views(messages: DataFrame) -> None:
    """The views ``messages`` and one for each kind, by its name."""
    tagged(messages).createOrReplaceTempView("messages")
    for tag, name in KIND_NAMES.items():
        decode(messages, tag).createOrReplaceTempView(name)
