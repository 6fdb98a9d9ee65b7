"""Hand vectors of every scalar function."""

import base64
import ipaddress

from pyspark.sql import functions as F

from gossamer.functions import binary as B
from gossamer.functions.addresses import addresses, read_addresses, type_name
from gossamer.functions.sql import register_functions


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def raw(spark, text, make):
    return one(spark, make(F.unhex(F.lit(text))))


VARINTS = {0: "00", 1: "01", 252: "fc", 253: "fdfd00", 65535: "fdffff", 65536: "fe00000100", 4294967295: "feffffffff", 4294967296: "ff0000000001000000", 2**64 - 1: "f" * 18}


def test_varint(spark):
    rows = spark.createDataFrame([(str(v), h) for v, h in VARINTS.items()], "v string, h string")
    got = rows.select("v", "h", F.lower(F.hex(B.varint_encode(F.col("v").cast("decimal(38,0)")))).alias("e"), B.varint_decode(F.unhex("h")).cast("string").alias("d")).collect()
    assert all(r.e == r.h and r.d == r.v for r in got)
    big = {"fdfd00": 0xFD00, "fe00000100": 0x100, "05": 5}
    for h, v in big.items():
        assert int(raw(spark, h, lambda b: B.varint_decode(b, big_endian=True))) == v
    assert raw(spark, "", B.varint_decode) is None and raw(spark, "fd01", B.varint_decode) is None
    for bad in (-1, 2**64):
        try:
            one(spark, B.varint_encode(F.lit(str(bad)).cast("decimal(38,0)")))
        except Exception as e:
            assert "varint out of range" in str(e)
        else:
            raise AssertionError("no error")


def test_scid(spark):
    for n, text in ((769658139524071425, "700000x1234x1"), (0, "0x0x0"), (-1, "16777215x16777215x65535")):
        assert one(spark, B.scid_text(F.lit(n).cast("long"))) == text
        assert one(spark, B.scid_of(F.lit(text))) == n
    assert one(spark, B.scid_of(F.lit("nonsense"))) is None


def test_integers(spark):
    assert int(raw(spark, "f" * 16, B.u64)) == 2**64 - 1
    assert raw(spark, "f" * 16, B.bits64) == -1
    assert raw(spark, "0102", lambda b: B.uint(b, 1, 2)) == 258
    assert raw(spark, "01", lambda b: B.uint(b, 1, 2)) is None
    assert raw(spark, "03", B.flag) == 1 and raw(spark, "02", B.flag) == 0
    assert raw(spark, "0c", B.store_version) == 0 and raw(spark, "ff", B.store_version) == 7


def test_reversal_is_by_bytes(spark):
    assert raw(spark, "c3a901", B.reversed_hex) == "01a9c3"
    assert raw(spark, bytes(range(32)).hex(), B.reversed_hex) == bytes(range(31, -1, -1)).hex()


def test_base32(spark):
    for n in (0, 1, 2, 3, 4, 5, 10, 35):
        data = bytes(range(n))
        assert raw(spark, data.hex(), B.base32) == base64.b32encode(data).decode().rstrip("=").lower()


def test_aliases(spark):
    cases = {"616263" + "00" * 29: ("abc", "abc"), "616263ff" + "00" * 28: ("616263ff" + "00" * 28, "abc"), "00616200": ("ab", "\x00ab"), "": ("", "")}
    for h, (strict, lossy) in cases.items():
        assert raw(spark, h, B.alias_strict) == strict
        assert raw(spark, h, B.alias_lossy) == lossy


def test_addresses(spark):
    v4, v6, dns = "017f0000012607", "0220010db80000000000000000000000012607", "050b6578616d706c652e636f6d2607"
    tor2, tor3 = "03" + bytes(range(10)).hex() + "2607", "04" + bytes(range(35)).hex() + "2607"
    texts = [a["addr"] for a in read_addresses(bytes.fromhex(v4 + v6 + dns + tor2 + tor3))]
    onion = [base64.b32encode(bytes(range(n))).decode().lower() + ".onion" for n in (10, 35)]
    assert texts == ["127.0.0.1", "[2001:db8::1]", "example.com", *onion]
    assert [a["addr"] for a in read_addresses(bytes.fromhex(v4 + "09aabb" + v4))] == ["127.0.0.1"]
    assert read_addresses(bytes.fromhex(v4 + "01ff")) == read_addresses(bytes.fromhex(v4))
    assert read_addresses(b"") == [] and read_addresses(None) is None
    mapped = bytes.fromhex("02" + "00" * 10 + "ffff01020304" + "0001")
    assert read_addresses(mapped)[0]["addr"] == f"[{ipaddress.IPv6Address(mapped[1:17])}]"
    got = raw(spark, v4 + dns, addresses)
    assert [(a.typ.id, a.typ.name, a.addr, a.port) for a in got] == [(1, "IPv4", "127.0.0.1", 9735), (5, "DNS", "example.com", 9735)]
    assert [one(spark, type_name(F.lit(k))) for k in (None, 0, 1, 5, 9)] == ["Unknown", "Unknown", "IPv4", "DNS", "Unknown"]


def test_gossip_id(spark):
    update = "00" * 64 + bytes(range(32)).hex() + "0aae600004d20001" + "5f5e1000" + "01" + "01" + "0028" + "00000000000003e8" + "000003e8" + "00000064" + "f" * 16
    assert raw(spark, "0102" + update, B.gossip_id) == "07f056b33c5d23074b94552307a296e2aacb4d8647a7fa620827931598abbf39"


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT scid_text(769658139524071425L) AS s, alias_strict(X'61620000') AS a, alias_lossy(X'00616200') AS l, address_type(4) AS t, message_tag(X'0102') AS m").first()
    assert (row.s, row.a, row.l, row.t, row.m) == ("700000x1234x1", "ab", "\x00ab", "Torv3", 258)
    rows = spark.sql("SELECT * FROM parse_addresses(X'017f0000012607')").collect()
    assert [tuple(r) for r in rows] == [(1, "IPv4", "127.0.0.1", 9735)]


def test_iso_time(spark):
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert one(spark, B.iso_time(F.lit(1_600_000_000).cast("long"))) == "2020-09-13T12:26:40"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
