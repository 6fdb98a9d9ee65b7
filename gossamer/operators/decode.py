"""Messages to typed columns, and back.

Decoding is a projection of native expressions: column pruning drops the fields a query does not ask for, and a filter on the tag
comes before any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import binary as B
from gossamer.schemas import ALL_TAGS, KIND_NAMES, LAYOUTS, SWAPPED


def tag_of(msg: Column) -> Column:
    """The two-byte tag of a message, or NULL where it is shorter."""
    return B.uint(msg, 1, 2).cast("int")


def known_tag(msg: Column) -> Column:
    """The tag if it is a known one, else NULL."""
    tag = tag_of(msg)
    return F.when(tag.isin(*ALL_TAGS), tag)


def strip_known_tag(msg: Column) -> Column:
    """The message without its tag where that is a known one, else the message as it is; NULL under two bytes."""
    return F.when(F.length(msg) < 2, F.lit(None).cast("binary")).when(known_tag(msg).isNotNull(), B.tail(msg, 3)).otherwise(msg)


def kind_name(tag: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair]), tag)


def tagged(messages: DataFrame, strict: bool = False) -> DataFrame:
    """messages (msg, ...) with tag, kind and payload. Unknown tags have a NULL kind; with ``strict`` they fail the query."""
    tag = tag_of(F.col("msg"))
    kind = kind_name(tag)
    if strict:
        kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown message tag "), F.coalesce(tag.cast("string"), F.lit("none")))).cast("string"))
    return messages.select("*", tag.alias("tag"), kind.alias("kind"), strip_known_tag(F.col("msg")).alias("payload"))


def fields_of(tag: int, payload: Column) -> dict[str, Column]:
    """The fields of a payload by name. Bytes behind the last field are ignored."""
    out: dict[str, Column] = {}
    at: Column = F.lit(1)
    for f in LAYOUTS[tag]:
        size: Column = F.lit(f.size)
        if f.reader == "sized":
            size = B.uint(payload, at, 2).cast("int")
            at = at + 2
            out[f.name] = B.cut(payload, at, size)
        elif f.reader == "bytes":
            out[f.name] = B.cut(payload, at, f.size)
        elif f.reader == "reversed":
            out[f.name] = B.reversed_bytes(B.cut(payload, at, f.size))
        elif f.reader == "scid":
            out[f.name] = B.bits64(payload, at)
        elif f.reader == "uint":
            out[f.name] = B.uint(payload, at, f.size)
        elif f.reader == "u64":
            out[f.name] = B.u64(payload, at)
        else:
            out[f.name] = F.when(B.flag(out[f.given_by]) == 1, B.u64(payload, at))
        at = at + size
    return out


def least_length(tag: int, payload: Column) -> Column:
    """The length a payload has at least to hold all its fields; NULL where not even the lengths can be read."""
    at: Column = F.lit(0)
    for f in LAYOUTS[tag]:
        if f.reader == "sized":
            at = at + 2 + B.uint(payload, at + 1, 2).cast("int")
        elif f.reader == "u64_if":
            at = at + F.when(B.flag(B.cut(payload, 109, 1)) == 1, f.size).otherwise(0)
        else:
            at = at + f.size
    return at


def decode(messages: DataFrame, tag: int, corrupt: str = "drop", swapped: bool = False) -> DataFrame:
    """One kind of message as a table: what came with the message (ord, file, ...) and the fields of the kind.

    ``corrupt``: messages too short for their fields are dropped (``drop``), kept with NULL fields and ``_corrupt`` true
    (``keep``) or fail the query (``fail``). ``swapped`` reads three internal tags by each other's layout.
    """
    if corrupt not in ("drop", "keep", "fail"):
        raise ValueError(f"corrupt is drop, keep or fail, not {corrupt!r}")
    layout = SWAPPED.get(tag, tag) if swapped else tag
    came = [c for c in messages.columns if c not in ("msg", "tag", "kind", "payload")]
    payload = F.col("payload")
    mine = messages.where(tag_of(F.col("msg")) == tag).select(*came, B.tail(F.col("msg"), 3).alias("payload"))
    whole = F.coalesce(F.length(payload) >= least_length(layout, payload), F.lit(False))
    fields = [c.alias(n) for n, c in fields_of(layout, payload).items()]
    if corrupt == "drop":
        return mine.where(whole).select(*came, *fields)
    if corrupt == "fail":
        checked = F.when(whole, payload).otherwise(F.raise_error(F.lit(f"{KIND_NAMES[tag]} message is cut short")).cast("binary"))
        return mine.withColumn("payload", checked).select(*came, *fields)
    kept = mine.withColumn("_corrupt", ~whole).withColumn("payload", F.when(whole, payload))
    return kept.select(*came, *fields, "_corrupt")


def decode_all(messages: DataFrame) -> DataFrame:
    """Every message with its kind and one struct column per kind, NULL for all kinds but its own and for what cannot be read."""
    out = tagged(messages)
    structs = []
    for tag in ALL_TAGS:
        payload = F.col("payload")
        whole = (F.col("tag") == tag) & F.coalesce(F.length(payload) >= least_length(tag, payload), F.lit(False))
        structs.append(F.when(whole, F.struct(*[c.alias(n) for n, c in fields_of(tag, payload).items()])).alias(KIND_NAMES[tag]))
    return out.select(*[c for c in out.columns if c != "payload"], *structs)


def nested(private: DataFrame, column: str, tag: int) -> DataFrame:
    """The public messages inside private ones, decoded: 4104 holds announcements (256), 4102 updates (258)."""
    came = [c for c in private.columns if c in ("file", "ord")]
    return decode(private.select(*came, F.col(column).alias("msg")), tag)


def presented(decoded: DataFrame) -> DataFrame:
    """A decoded table for people and JSON: bytes as lower-case hex, channel ids as text, aliases and addresses read."""
    from gossamer.functions.addresses import addresses

    out = []
    for name, kind in decoded.dtypes:
        c = F.col(name)
        if name == "alias" and kind == "binary":
            out.append(B.alias_strict(c).alias(name))
        elif name == "addresses" and kind == "binary":
            out.append(addresses(c).alias(name))
        elif kind == "binary":
            out.append(B.hex_lower(c).alias(name))
        elif name == "scid":
            out.append(B.scid_text(c).alias(name))
        else:
            out.append(c)
    return decoded.select(*out)


def encode(rows: DataFrame, tag: int, ord_col: str = "ord") -> DataFrame:
    """(ord, msg): rows with the fields of a kind as messages with their tag; the inverse of ``decode``."""
    parts = [F.unhex(F.lit(f"{tag:04x}"))]
    for f in LAYOUTS[tag]:
        c = F.col(f.name)
        if f.reader == "sized":
            parts += [B.bytes_of(F.length(c), 2), c]
        elif f.reader == "bytes":
            parts.append(c)
        elif f.reader == "reversed":
            parts.append(B.reversed_bytes(c))
        elif f.reader == "u64_if":
            parts.append(F.coalesce(F.when(B.flag(F.col(f.given_by)) == 1, B.bytes_of(c, f.size)), F.unhex(F.lit(""))))
        else:
            parts.append(B.bytes_of(c, f.size))
    return rows.select(F.col(ord_col).cast("long").alias("ord"), F.concat(*parts).alias("msg"))


def tag_counts(messages: DataFrame) -> DataFrame:
    """(tag, kind, messages), unknown tags included."""
    return tagged(messages).groupBy("tag", "kind").agg(F.count("*").alias("messages"))
