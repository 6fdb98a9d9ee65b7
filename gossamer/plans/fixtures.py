"""Gossip made of the driver's tables: rows with the fields of each kind, encoded to messages, so that every query runs from wire bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.checkpoints import checkpoint
from gossamer.operators.decode import decode
from gossamer.operators.decode import encode as _encode


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Epoch seconds of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def filled(value: Column, size: int, head: str = "") -> Column:
    """``size`` bytes: a fixed head, then a number, zeros between."""
    return F.unhex(F.concat(F.lit(head), F.lpad(F.hex(value.cast("long")), 2 * size - len(head), "0")))


def encode(rows: DataFrame, tag: int) -> DataFrame:
    """Messages kept as such, as they would lie in files: plans on top read bytes, and do not make them."""
    return checkpoint(_encode(rows, tag))


#: Messages by application, directory and name: made once, and read by every query of a session.
_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The messages of one kind, by name, made of the tables in ``sf_dir`` when they are first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        rows, tag = {
            "channels": (channel_rows, 256), "nodes": (node_rows, 257), "updates": (update_rows, 258), "spread": (lambda s, d: update_rows(s, d, True), 258),
        }[name]
        _KEPT[key] = encode(rows(spark, sf_dir), tag)
    return _KEPT[key]


def update_rows(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Channel updates from events: a channel for each user, or with ``spread`` for each user and event number modulo 100."""
    e = F.col("event_id")
    scid = F.shiftleft("user_id", 40)
    hours = seconds("ts") - F.pmod(seconds("ts"), F.lit(3600))
    given = e % 3 != 0
    return table(spark, sf_dir, "events").select(
        e.alias("ord"), filled(e, 64).alias("signature"), F.unhex(F.sha2(F.col("user_id").cast("string").cast("binary"), 256)).alias("chain_hash"),
        (scid.bitwiseOR(F.shiftleft(e % 100, 16)) if spread else scid).alias("scid"), hours.alias("timestamp"),
        F.unhex(F.when(given, "01").otherwise("00")).alias("message_flags"), F.unhex(F.concat(F.lit("0"), (e % 2).cast("string"))).alias("channel_flags"),
        (e % 144).alias("cltv_expiry_delta"), (e * 1000).cast("decimal(20,0)").alias("htlc_minimum_msat"),
        F.floor(F.col("value") * 100).cast("long").alias("fee_base_msat"), (F.floor("value") % 100).cast("long").alias("fee_proportional_millionths"),
        F.when(given, e * 1000 + 7).cast("decimal(20,0)").alias("htlc_maximum_msat"),
    )


def peer() -> Column:
    """The number of the second node of an order's channel: one of ten that ten customers share."""
    return F.col("o_custkey") - F.col("o_custkey") % 10 + F.col("o_orderkey") % 10


def channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel announcements from orders: customers to peers, some channels announced again and many pairs linked twice."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    sig = lambda k: filled(o + k, 64)
    return table(spark, sf_dir, "orders").select(
        o.alias("ord"), sig(1).alias("node_signature_1"), sig(2).alias("node_signature_2"), sig(3).alias("bitcoin_signature_1"), sig(4).alias("bitcoin_signature_2"),
        F.unhex(F.repeat(F.lit("01"), (o % 4).cast("int"))).alias("features"), F.unhex(F.sha2(F.col("o_orderstatus").cast("binary"), 256)).alias("chain_hash"),
        F.shiftleft(c, 40).bitwiseOR(F.shiftleft(o % 100, 16)).alias("scid"), filled(c, 33, "03").alias("node_id_1"), filled(peer(), 33, "02").alias("node_id_2"),
        filled(o + 5, 33, "02").alias("bitcoin_key_1"), filled(o + 6, 33, "03").alias("bitcoin_key_2"),
    )


def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node announcements from orders: of customers, of their peers, and of nodes without channels."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    node = F.when(o % 4 < 2, filled(c, 33, "03")).when(o % 4 == 2, filled(peer(), 33, "02")).otherwise(filled(o + 10_000_000, 33, "02"))
    name = F.concat(F.lit("Node#"), F.lpad(c.cast("string"), 9, "0"))
    address = F.concat(F.unhex(F.lit("01")), F.unhex(F.lpad(F.hex(c), 8, "0")), F.unhex(F.lit("2607")))
    return table(spark, sf_dir, "orders").select(
        o.alias("ord"), filled(o, 64).alias("signature"), F.unhex(F.repeat(F.lit("02"), (o % 3).cast("int"))).alias("features"), seconds("o_orderdate").alias("timestamp"),
        node.alias("node_id"), F.unhex(F.lpad(F.hex(o % 16777216), 6, "0")).alias("rgb_color"),
        F.concat(name.cast("binary"), F.unhex(F.repeat(F.lit("00"), 18))).alias("alias"), F.when(o % 5 == 0, F.unhex(F.lit(""))).otherwise(address).alias("addresses"),
    )


def updates(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return decode(kept(spark, sf_dir, "spread" if spread else "updates"), 258)


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(kept(spark, sf_dir, "channels"), 256)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(kept(spark, sf_dir, "nodes"), 257)


def internal_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message of each internal kind for every order; ``ord`` is the order's key."""
    o = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        o.alias("ord"), (o * 1000).cast("decimal(20,0)").alias("satoshis"), (o * 999).cast("decimal(20,0)").alias("amount_sat"), (o + 12).cast("decimal(20,0)").alias("equivalent_offset"),
        F.shiftleft("o_custkey", 40).bitwiseOR(F.shiftleft(o % 100, 16)).bitwiseOR(o % 7).alias("scid"), (F.col("o_custkey") + 700_000).alias("blockheight"),
    )
    public, held = kept(spark, sf_dir, "channels"), kept(spark, sf_dir, "updates")
    out = encode(orders, 4101)
    for tag in (4103, 4105, 4106):
        out = out.union(encode(orders, tag))
    out = out.union(encode(orders.join(public.select("ord", F.col("msg").alias("announcement")), "ord"), 4104))
    return out.union(encode(held.select("ord", F.col("msg").alias("update")), 4102))


def all_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = kept(spark, sf_dir, "channels").union(kept(spark, sf_dir, "nodes")).union(kept(spark, sf_dir, "updates"))
    unknown = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.unhex(F.lit("0001ff")).alias("msg"))
    return public.union(internal_messages(spark, sf_dir)).union(unknown)
