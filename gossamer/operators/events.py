"""Event envelopes: JSON text to validated columns.

The checks run in a fixed order and the first that fails is the row's ``error``. Types are those of the JSON values, looked at
through VARIANT: a boolean counts as an integer, as it does in the language the format comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions.binary import gossip_id

HEX = r"^(\s*[0-9a-fA-F]{2})*\s*$"


def is_hex(text: Column) -> Column:
    """Pairs of hex digits, with white space between pairs allowed."""
    return text.rlike(HEX)


def _kind(v: str, path: str) -> Column:
    """The JSON type at a path: its Spark name, VOID for null, NULL if nothing is there."""
    return F.expr(f"schema_of_variant(try_variant_get({v}, '{path}', 'variant'))")


def validate_events(events: DataFrame, column: str = "event", verify_id: bool = False) -> DataFrame:
    """events with ``valid``, ``error``, ``type``, ``id``, ``timestamp`` and ``raw_gossip_hex``; the fields are NULL in invalid rows.

    ``verify_id`` also asks that the id is the SHA-256 of the raw message.
    """
    kept = events.columns
    v = events.withColumn("__v", F.expr(f"try_parse_json(`{column}`)"))
    integer = lambda c: c.isin("BIGINT", "BOOLEAN")
    whole, meta = F.expr("schema_of_variant(__v)"), _kind("__v", "$.metadata")
    text = lambda path: F.expr(f"try_variant_get(__v, '{path}', 'string')")
    id_, raw = text("$.metadata.id"), text("$.raw_gossip_hex")
    missing = lambda k: _kind("__v", f"$.metadata.{k}").isNull()
    error = (
        F.when(whole.isNull() | ~whole.startswith("OBJECT"), "not an object")
        .when(meta.isNull() | ~meta.startswith("OBJECT"), "no metadata object")
        .when(missing("type") | missing("id") | missing("timestamp"), "missing keys in metadata")
        .when(~integer(_kind("__v", "$.metadata.type")), "metadata.type is not an integer")
        .when(_kind("__v", "$.metadata.id") != "STRING", "metadata.id is not a string")
        .when(F.length(id_) != 64, "metadata.id has not 64 characters")
        .when(~is_hex(id_), "metadata.id is not hex")
        .when(~integer(_kind("__v", "$.metadata.timestamp")), "metadata.timestamp is not an integer")
        .when(F.coalesce(_kind("__v", "$.raw_gossip_hex"), F.lit("")) != "STRING", "raw_gossip_hex is not a string")
        .when(~is_hex(raw), "raw_gossip_hex is not hex")
    )
    if verify_id:
        data = F.unhex(F.regexp_replace(raw, r"\s", ""))
        error = error.when(F.lower(id_) != gossip_id(data), "metadata.id is not the message's SHA-256")
    number = lambda path: F.coalesce(F.expr(f"try_variant_get(__v, '{path}', 'bigint')"), F.expr(f"try_variant_get(__v, '{path}', 'boolean')").cast("long"))
    checked = v.withColumn("error", error)
    ok = F.col("error").isNull()
    return checked.select(
        *kept, ok.alias("valid"), "error", F.when(ok, number("$.metadata.type")).alias("type"), F.when(ok, id_).alias("id"),
        F.when(ok, number("$.metadata.timestamp")).alias("timestamp"), F.when(ok, raw).alias("raw_gossip_hex"),
    )


def platform_event(message: Column, kind: Column, timestamp: Column) -> Column:
    """The envelope of a raw message as JSON text."""
    metadata = F.struct(kind.cast("int").alias("type"), gossip_id(message).alias("id"), timestamp.cast("long").alias("timestamp"))
    return F.to_json(F.struct(metadata.alias("metadata"), F.lower(F.hex(message)).alias("raw_gossip_hex")))


def plugin_events(events: DataFrame, column: str = "event") -> DataFrame:
    """Envelopes of a node's plugin, with the raw message they hold as ``msg``; unreadable ones have NULLs."""
    schema = "metadata STRUCT<type: INT, timestamp: BIGINT, sender_node_id: STRING, length: STRING>, raw_hex STRING"
    read = events.withColumn("__e", F.from_json(column, schema))
    return read.select(*events.columns, "__e.metadata", "__e.raw_hex", F.when(is_hex(F.col("__e.raw_hex")), F.unhex(F.regexp_replace("__e.raw_hex", r"\s", ""))).alias("msg"))


def arrivals(events: DataFrame, key: str = "id", time: str = "timestamp") -> DataFrame:
    """(id, times): when each message arrived, ascending; the shape of a duplicate cache."""
    return events.groupBy(key).agg(F.sort_array(F.collect_list(time)).alias("times"))
