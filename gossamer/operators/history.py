"""The history at a time, between two times, and for many probes at once.

A message counts at ``t`` if its timestamp is at most ``t``; an interval leaves out its start and takes in its end, so a
snapshot and the difference that follows it make up the later snapshot. Channel announcements carry no timestamp of their own: they count
by ``rec_ts`` where the store recorded one, else always.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.operators import graph as G


def _time(value) -> Column:
    """A datetime, timestamp column or number of epoch seconds as epoch seconds; naive datetimes are UTC."""
    from datetime import datetime, timezone

    if isinstance(value, datetime):
        return F.lit(int((value if value.tzinfo else value.replace(tzinfo=timezone.utc)).timestamp()))
    return value if isinstance(value, Column) else F.lit(int(value))


def _seconds(value) -> int | None:
    from datetime import datetime, timezone

    if isinstance(value, datetime):
        return int((value if value.tzinfo else value.replace(tzinfo=timezone.utc)).timestamp())
    return int(value)


def known_at(channels: DataFrame, t) -> DataFrame:
    """Channel announcements that were recorded by ``t``, or without a recording time."""
    return channels.where(F.col("rec_ts").isNull() | (F.col("rec_ts") <= _time(t))) if "rec_ts" in channels.columns else channels


def snapshot(channels: DataFrame, announcements: DataFrame, updates: DataFrame, t, simple: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the graph as of ``t``; ``simple`` collapses parallel channels."""
    channels = known_at(channels, t)
    announcements, updates = (d.where(F.col("timestamp") <= _time(t)) for d in (announcements, updates))
    edges = G.multi_edges(channels, updates)
    return G.vertices(channels, announcements), G.simple_edges(edges) if simple else edges


def fee_changes(updates: DataFrame, by: Sequence[str] = ("scid",)) -> DataFrame:
    """The first update of each group, and every one whose base or proportional fee differs from the one before it."""
    if "direction" in by:
        updates = G.with_direction(updates)
    order = Window.partitionBy(*by).orderBy("timestamp", "ord")
    fees = F.struct("fee_base_msat", "fee_proportional_millionths")
    marked = updates.withColumn("__before", F.lag(fees).over(order)).withColumn("__same", F.col("__before").eqNullSafe(fees))
    return marked.where(F.col("__before").isNull() | ~F.col("__same")).drop("__before", "__same")


def diff(channels: DataFrame, announcements: DataFrame, updates: DataFrame, start, end, only_fee_changes: bool = False, by: Sequence[str] = ("scid",)) -> dict[str, DataFrame]:
    """What arrived in (start, end], by kind. A start at or behind the end is a ValueError."""
    if _seconds(start) >= _seconds(end):
        raise ValueError("the start must lie before the end")
    between = lambda d, c: d.where((F.col(c) > _time(start)) & (F.col(c) <= _time(end)))
    changed = between(updates, "timestamp")
    return {
        "channel_announcements": between(channels, "rec_ts") if "rec_ts" in channels.columns else channels,
        "node_announcements": between(announcements, "timestamp"),
        "channel_updates": fee_changes(changed, by) if only_fee_changes else changed,
    }


def node_at(announcements: DataFrame, node_id: str, t) -> DataFrame:
    """The announcement of a node (hex) that held at ``t``."""
    if not node_id:
        raise ValueError("a node id is needed")
    return G.latest_nodes(announcements.where((F.col("node_id") == F.unhex(F.lit(node_id))) & (F.col("timestamp") <= _time(t))))


def channel_at(channels: DataFrame, updates: DataFrame, scid: str, t) -> DataFrame:
    """The two directed edges of a channel, named as block x transaction x output, as of ``t``."""
    from gossamer.functions.binary import scid_of

    if not scid:
        raise ValueError("a channel id is needed")
    wanted = scid_of(F.lit(scid))
    return G.multi_edges(known_at(channels, t).where(F.col("scid") == wanted), updates.where((F.col("scid") == wanted) & (F.col("timestamp") <= _time(t))))


def asof_join(probes: DataFrame, states: DataFrame, keys: Sequence[str], probe_time: str = "at", state_time: str = "timestamp", state_order: str = "ord") -> DataFrame:
    """Each probe with ``state``, the state of its keys that held at its time, or NULL.

    Of states with equal times the first seen holds. One sort by key and time instead of a range join: states and probes run
    together, and each probe takes the last state before it.
    """
    rest = [c for c in states.columns if c not in keys]
    own = [c for c in probes.columns if c not in keys]
    left = states.select(*keys, F.col(state_time).alias("__t"), (-F.col(state_order)).alias("__o"), F.lit(0).alias("__side"), F.struct(*rest).alias("state"), F.lit(None).cast(probes.select(F.struct(*own)).schema[0].dataType).alias("probe"))
    right = probes.select(*keys, F.col(probe_time).alias("__t"), F.lit(0).cast("long").alias("__o"), F.lit(1).alias("__side"), F.lit(None).cast(left.schema["state"].dataType).alias("state"), F.struct(*own).alias("probe"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("held", F.last("state", ignorenulls=True).over(w)).where("__side = 1")
    return both.select(*keys, "probe.*", F.col("held").alias("state"))
