"""The channel graph from decoded messages.

Order decides ties, so every table carries ``ord``, the place of a message in the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import binary as B
from gossamer.functions.addresses import addresses

CHANNEL_FIELDS = ("features", "chain_hash", "bitcoin_key_1", "bitcoin_key_2", "node_signature_1", "node_signature_2", "bitcoin_signature_1", "bitcoin_signature_2")
UPDATE_FIELDS = ("timestamp", "cltv_expiry_delta", "htlc_minimum_msat", "fee_base_msat", "fee_proportional_millionths", "htlc_maximum_msat", "message_flags", "channel_flags")


def direction(channel_flags: Column) -> Column:
    return B.flag(channel_flags)


def _first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. Ranks are limited in each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def with_direction(updates: DataFrame) -> DataFrame:
    return updates if "direction" in updates.columns else updates.withColumn("direction", direction(F.col("channel_flags")))


def latest_updates(updates: DataFrame) -> DataFrame:
    """The latest update of each channel and direction; of equal timestamps the first seen."""
    return _first(with_direction(updates), ["scid", "direction"], F.desc("timestamp"), F.asc("ord"))


def latest_nodes(announcements: DataFrame) -> DataFrame:
    """The latest announcement of each node; of equal timestamps the first seen."""
    return _first(announcements, ["node_id"], F.desc("timestamp"), F.asc("ord"))


def last_channels(announcements: DataFrame) -> DataFrame:
    """Each channel as last announced, with ``pos``, the place of its first announcement."""
    own = Window.partitionBy("scid")
    # one exchange and one sort, and columns that nobody asks for are pruned before them
    ranked = announcements.withColumn("__rank", F.row_number().over(own.orderBy(F.desc("ord")))).withColumn("pos", F.min("ord").over(own))
    return ranked.where("__rank = 1").select("scid", *[c for c in announcements.columns if c != "scid"], "pos")


def announcement_counts(announcements: DataFrame) -> DataFrame:
    """(node_id, announcements, first_ord)."""
    return announcements.groupBy("node_id").agg(F.count("*").alias("announcements"), F.min("ord").alias("first_ord"))


def most_announced(announcements: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` nodes announced most often, and more than once; of equal counts the first seen."""
    return announcement_counts(announcements).where("announcements > 1").orderBy(F.desc("announcements"), "first_ord").limit(n)


def multi_edges(channels: DataFrame, updates: DataFrame) -> DataFrame:
    """Two directed edges for each channel with the latest update of their direction, if any.

    (src, dst, scid, direction, pos, the channel's fields in hex, has_update, update). Updates of unknown channels are dropped.
    """
    own = [c for c in CHANNEL_FIELDS if c in channels.columns]
    one, two = B.hex_lower(F.col("node_id_1")), B.hex_lower(F.col("node_id_2"))
    ways = F.array(
        F.struct(one.alias("src"), two.alias("dst"), F.lit(0).alias("direction")), F.struct(two.alias("src"), one.alias("dst"), F.lit(1).alias("direction"))
    )
    hexed = [B.hex_lower(F.col(c)).alias(c) for c in own]
    base = last_channels(channels).select("scid", "pos", *hexed, F.explode(ways).alias("way")).select("scid", "pos", *own, "way.*")
    flags = ("message_flags", "channel_flags")
    fields = [B.hex_lower(F.col(c)).alias(c) if c in flags else F.col(c) for c in UPDATE_FIELDS]
    latest = latest_updates(updates).select("scid", "direction", F.struct(*fields).alias("update"))
    joined = base.join(latest, ["scid", "direction"], "left")
    return joined.select("src", "dst", B.scid_text(F.col("scid")).alias("scid"), "direction", "pos", *own, F.col("update").isNotNull().alias("has_update"), "update")


def orphan_updates(channels: DataFrame, updates: DataFrame) -> DataFrame:
    """The latest updates whose channel was never announced."""
    return latest_updates(updates).join(channels.select("scid").distinct(), "scid", "left_anti")


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair of nodes, as a simple directed graph keeps it.

    Later channels, by first place and direction, win; an update stays until a later channel of the pair brings its own, while
    ``has_update`` is the last channel's.
    """
    last = Window.partitionBy("src", "dst").orderBy(F.desc("pos"), F.desc("direction"))
    every = last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = edges.withColumn("__rank", F.row_number().over(last)).withColumn("__update", F.first("update", ignorenulls=True).over(every))
    base = [c for c in edges.columns if c not in ("src", "dst", "pos", "has_update", "update")]
    return ranked.where("__rank = 1").select("src", "dst", *base, "has_update", F.col("__update").alias("update"))


def links(channels: DataFrame) -> DataFrame:
    """(src, dst) of every channel, once: what connectivity needs of the edges."""
    one, two = B.hex_lower(F.col("node_id_1")), B.hex_lower(F.col("node_id_2"))
    return last_channels(channels).select(one.alias("src"), two.alias("dst"))


def endpoints(channels: DataFrame) -> DataFrame:
    """(node_id) of every node that a channel ends at."""
    ends = last_channels(channels).select(F.explode(F.array("node_id_1", "node_id_2")).alias("node_id"))
    return ends.select(B.hex_lower(F.col("node_id")).alias("node_id")).distinct()


def announced_nodes(announcements: DataFrame) -> DataFrame:
    """Nodes as last announced, in their presented form."""
    return latest_nodes(announcements).select(
        B.hex_lower(F.col("node_id")).alias("node_id"), F.lit(True).alias("announced"), "timestamp", B.hex_lower(F.col("features")).alias("features"),
        B.hex_lower(F.col("rgb_color")).alias("rgb_color"), B.alias_lossy(F.col("alias")).alias("alias"), addresses(F.col("addresses")).alias("addresses"),
        B.hex_lower(F.col("signature")).alias("signature"),
    )


def unannounced_nodes(channels: DataFrame, announcements: DataFrame) -> DataFrame:
    """Ends of channels that were never announced."""
    known = announcements.select(B.hex_lower(F.col("node_id")).alias("node_id")).distinct()
    return endpoints(channels).join(known, "node_id", "left_anti")


def isolated_nodes(channels: DataFrame, announcements: DataFrame) -> DataFrame:
    """Announced nodes without a channel."""
    known = announcements.select(B.hex_lower(F.col("node_id")).alias("node_id")).distinct()
    return known.join(endpoints(channels), "node_id", "left_anti")


def vertices(channels: DataFrame, announcements: DataFrame) -> DataFrame:
    """Announced nodes with what they announced, and the other ends of channels with NULLs."""
    bare = unannounced_nodes(channels, announcements).withColumn("announced", F.lit(False))
    return announced_nodes(announcements).unionByName(bare, allowMissingColumns=True)


def graph_stats(channels: DataFrame, announcements: DataFrame, updates: DataFrame) -> DataFrame:
    """One row: nodes, announced, unannounced, isolated, edges, channels, updates."""
    known = announcements.select(B.hex_lower(F.col("node_id")).alias("node_id")).distinct().withColumn("a", F.lit(True))
    nodes = known.join(endpoints(channels).withColumn("e", F.lit(True)), "node_id", "full").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("a").isNotNull()).alias("announced"),
        F.count_if(F.col("a").isNull()).alias("unannounced"), F.count_if(F.col("e").isNull()).alias("isolated"),
    )
    ends = last_channels(channels).select(F.explode(F.array(F.struct(F.col("node_id_1").alias("a"), F.col("node_id_2").alias("b")), F.struct(F.col("node_id_2").alias("a"), F.col("node_id_1").alias("b")))).alias("p"))
    edges = ends.select("p.*").distinct().agg(F.count("*").alias("edges"))
    own = channels.agg(F.count_distinct("scid").alias("channels"))
    latest = with_direction(updates).select("scid", "direction").distinct().agg(F.count("*").alias("updates"))
    # each side is one row
    return nodes.join(edges).join(own).join(latest)
