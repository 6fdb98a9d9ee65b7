"""Address lists of node announcements.

The lists are short and of variable layout, and the text of an IPv6 address has no built-in expression, so they are read in Arrow
batches, and only when a plan asks for them.
"""

from __future__ import annotations

import base64
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the protocol.
ADDRESS_TYPES = {1: "IPv4", 2: "IPv6", 3: "Torv2", 4: "Torv3", 5: "DNS"}
ADDRESS_DDL = "struct<typ:struct<id:int,name:string>,addr:string,port:int>"
_SIZES = {1: 4, 2: 16, 3: 10, 4: 35}


def read_addresses(data: bytes | None) -> list[dict] | None:
    """The addresses of a list up to its end or the first one that cannot be read."""
    if data is None:
        return None
    out, at = [], 0
    while at < len(data):
        kind, at = data[at], at + 1
        if kind == 5 and at < len(data):
            size, at = data[at], at + 1
        elif kind in _SIZES:
            size = _SIZES[kind]
        else:
            break
        body, port = data[at : at + size], data[at + size : at + size + 2]
        if len(body) < size or len(port) < 2:
            break
        if kind == 1:
            text = str(ipaddress.IPv4Address(body))
        elif kind == 2:
            text = f"[{ipaddress.IPv6Address(body)}]"
        elif kind == 5:
            if not body.isascii():
                break
            text = body.decode("ascii")
        else:
            text = base64.b32encode(body).decode().rstrip("=").lower() + ".onion"
        out.append({"typ": {"id": kind, "name": ADDRESS_TYPES[kind]}, "addr": text, "port": int.from_bytes(port, "big")})
        at += size + 2
    return out


def addresses(b: Column) -> Column:
    """The address list as ARRAY<STRUCT<typ, addr, port>>."""

    @F.pandas_udf(f"array<{ADDRESS_DDL}>")
    def read(lists: pd.Series) -> pd.Series:
        return lists.map(read_addresses)

    return read(b)


def type_name(kind: Column) -> Column:
    """The name of an address type; ``Unknown`` for NULL and any other number."""
    names = F.create_map(*[F.lit(x) for pair in ADDRESS_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, kind.cast("int")), F.lit("Unknown"))


@F.udtf(returnType="type_id int, type_name string, addr string, port int")
class ParseAddresses:
    """``parse_addresses(list)`` in SQL: one row for each address."""

    def eval(self, data: bytes):
        for a in read_addresses(data) or []:
            yield a["typ"]["id"], a["typ"]["name"], a["addr"], a["port"]
