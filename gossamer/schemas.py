"""Message kinds, their layouts and the schemas that decoding gives."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the protocol and of the store format.
KIND_NAMES = {
    256: "channel_announcement",
    257: "node_announcement",
    258: "channel_update",
    4101: "channel_amount",
    4102: "private_update",
    4103: "delete_channel",
    4104: "private_channel",
    4105: "ended",
    4106: "channel_dying",
}
PUBLIC_TAGS = (256, 257, 258)
INTERNAL_TAGS = (4101, 4102, 4103, 4104, 4105, 4106)
ALL_TAGS = PUBLIC_TAGS + INTERNAL_TAGS
#: The swapped dispatch of three internal tags that some readers use: tag -> tag whose layout they apply.
SWAPPED = {4102: 4104, 4103: 4102, 4104: 4103}


@dataclass(frozen=True)
class Field:
    """``reader``: bytes, reversed (bytes, reversed), scid, u64, uint, sized (u16 length, then bytes), or u64_if (optional)."""

    name: str
    reader: str
    size: int = 0
    #: For ``u64_if``: the field whose lowest bit says that the value is there.
    given_by: str = ""


LAYOUTS: dict[int, tuple[Field, ...]] = {
    256: (
        Field("node_signature_1", "bytes", 64), Field("node_signature_2", "bytes", 64),
        Field("bitcoin_signature_1", "bytes", 64), Field("bitcoin_signature_2", "bytes", 64),
        Field("features", "sized"), Field("chain_hash", "reversed", 32), Field("scid", "scid", 8),
        Field("node_id_1", "bytes", 33), Field("node_id_2", "bytes", 33),
        Field("bitcoin_key_1", "bytes", 33), Field("bitcoin_key_2", "bytes", 33),
    ),
    257: (
        Field("signature", "bytes", 64), Field("features", "sized"), Field("timestamp", "uint", 4),
        Field("node_id", "bytes", 33), Field("rgb_color", "bytes", 3), Field("alias", "bytes", 32), Field("addresses", "sized"),
    ),
    258: (
        Field("signature", "bytes", 64), Field("chain_hash", "reversed", 32), Field("scid", "scid", 8),
        Field("timestamp", "uint", 4), Field("message_flags", "bytes", 1), Field("channel_flags", "bytes", 1),
        Field("cltv_expiry_delta", "uint", 2), Field("htlc_minimum_msat", "u64", 8), Field("fee_base_msat", "uint", 4),
        Field("fee_proportional_millionths", "uint", 4), Field("htlc_maximum_msat", "u64_if", 8, "message_flags"),
    ),
    4101: (Field("satoshis", "u64", 8),),
    4102: (Field("update", "sized"),),
    4103: (Field("scid", "scid", 8),),
    4104: (Field("amount_sat", "u64", 8), Field("announcement", "sized")),
    4105: (Field("equivalent_offset", "u64", 8),),
    4106: (Field("scid", "scid", 8), Field("blockheight", "uint", 4)),
}

_TYPES = {"bytes": "binary", "reversed": "binary", "sized": "binary", "scid": "bigint", "uint": "bigint", "u64": "decimal(20,0)", "u64_if": "decimal(20,0)"}


def schema_of(tag: int) -> str:
    """The schema of a decoded kind, as DDL."""
    return ", ".join(f"`{f.name}` {_TYPES[f.reader]}" for f in LAYOUTS[tag])


RAW_DDL = "file STRING, ord BIGINT, msg BINARY, rec_flags INT, rec_crc BIGINT, rec_ts BIGINT"
