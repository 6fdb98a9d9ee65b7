"""The same history as streams: the batch expressions on streaming DataFrames, with state only where an answer needs it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gossamer.functions.binary import gossip_id
from gossamer.operators.graph import with_direction


def event_time(df: DataFrame, seconds: str = "timestamp") -> DataFrame:
    """df with ``event_time`` from epoch seconds."""
    return df.withColumn("event_time", F.timestamp_seconds(seconds))


def deduplicated(messages: DataFrame, time: str = "event_time", late: str = "1 hour", key: str | None = None) -> DataFrame:
    """Each message once within the watermark, by its gossip id or by a column that names it; state leaves with the watermark."""
    named = messages if key else messages.withColumn("gossip_id", gossip_id(F.col("msg")))
    return named.withWatermark(time, late).dropDuplicatesWithinWatermark([key or "gossip_id"])


def activity(messages: DataFrame, by: str = "kind", time: str = "event_time", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, end, by, messages) for each window of event time."""
    windowed = messages.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return windowed.agg(F.count("*").alias("messages")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "messages")


def changed_fees(updates: DataFrame, by: tuple[str, ...] = ("scid",)) -> DataFrame:
    """Updates whose fees differ from the last ones of their group, and first ones, with the last fees as the only state.

    Within a micro-batch a group's updates are taken in the order of time and place; updates older than what the group has seen are late
    and left out.
    """
    if "direction" in by:
        updates = with_direction(updates)
    columns = [*by, "timestamp", "ord", "fee_base_msat", "fee_proportional_millionths"]
    rows = updates.select(*[F.col(c).cast("long").alias(c) for c in columns])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        new = pd.concat(list(frames)).sort_values(["timestamp", "ord"])
        keep = []
        for r in new.itertuples(index=False):
            now = (r.timestamp, r.ord, r.fee_base_msat, r.fee_proportional_millionths)
            if last is not None and now[:2] <= tuple(last[:2]):
                keep.append(False)
                continue
            keep.append(last is None or now[2:] != tuple(last[2:]))
            last = now
        state.update(tuple(int(x) for x in last))
        yield new[keep]

    ddl = ", ".join(f"{c} long" for c in columns)
    return rows.groupBy(*by).applyInPandasWithState(step, ddl, "timestamp long, ord long, base long, ppm long", "append", GroupStateTimeout.NoTimeout)


def upsert_latest(updates: DataFrame, path: str):
    """A streaming writer that keeps the latest update of each channel and direction in Parquet under ``path``.

    Each batch is merged with the version before it by the batch rule and written as a version of its own, so a batch that is
    run again after a failure writes the same version. Start it with ``.start()``; read it with ``latest_version``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = with_direction(batch)
        before = latest_version(spark, path, number)
        both = rows if before is None else before.unionByName(rows)
        order = Window.partitionBy("scid", "direction").orderBy(F.desc("timestamp"), F.asc("ord"))
        kept = both.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
        kept.write.mode("overwrite").parquet(f"{path}/version={number:010d}")

    return updates.writeStream.foreachBatch(merge)


def latest_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last version under ``path``, or the last one before a batch; None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{path}/version={numbers[-1]:010d}") if numbers else None


def peers(events: DataFrame, key: str = "id", sender: str = "sender", time: str = "event_time", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(id, senders, times) for each window of time: which peers delivered a message, and when."""
    seen = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return seen.agg(F.sort_array(F.collect_set(sender)).alias("senders"), F.sort_array(F.collect_list(time)).alias("times")).select(F.col("w.start").alias("start"), key, "senders", "times")
