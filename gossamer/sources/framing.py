"""The four framings of message files, over seekable binary streams.

A length leads from one message to the next, so a file is hopped over by its headers to find where parts of it may begin.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

# Fixed values of the formats.
PGCOPY_SIGNATURE = bytes.fromhex("5047434f50590aff0d0a00")
GSP_MAGIC = b"GSP\x01"
FRAMINGS = ("pgcopy", "varint", "gsp", "gossip_store")


class FramingError(ValueError):
    """A file that ends inside a message, or breaks its format."""


class Frame(NamedTuple):
    """Where a message stands in its file, and what its header said."""

    at: int
    size: int
    flags: int | None = None
    crc: int | None = None
    ts: int | None = None


def detect(head: bytes) -> str:
    """The framing that a file's first bytes show. A plain file whose first message is under 32 bytes looks like a store: name its framing."""
    if head.startswith(PGCOPY_SIGNATURE):
        return "pgcopy"
    if head.startswith(GSP_MAGIC):
        return "gsp"
    if head and head[0] >> 5 == 0:
        return "gossip_store"
    return "varint"


def _exact(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise FramingError(f"{n} bytes expected, {len(data)} found")
    return data


def _varint(f: BinaryIO, order: str) -> int | None:
    """The next variable-length integer; None at the end of the file or inside a length."""
    first = f.read(1)
    if not first:
        return None
    width = {0xFD: 2, 0xFE: 4, 0xFF: 8}.get(first[0], 0)
    body = f.read(width)
    if len(body) < width:
        return None
    return int.from_bytes(body, order) if width else first[0]


def begin(f: BinaryIO, framing: str, skip_version: bool = True) -> None:
    """Step over a file's header."""
    if framing == "pgcopy":
        if _exact(f, 11) != PGCOPY_SIGNATURE:
            raise FramingError("no COPY signature")
        _, extension = struct.unpack(">II", _exact(f, 8))
        _exact(f, extension)
    elif framing == "gsp":
        if _exact(f, 4) != GSP_MAGIC:
            raise FramingError("no GSP magic")
    elif framing == "gossip_store" and skip_version:
        f.read(1)


def _next(f: BinaryIO, framing: str) -> Frame | None:
    """The next frame, with the stream at its message; None at the end. A NULL field gives a frame of size -1."""
    if framing == "pgcopy":
        (columns,) = struct.unpack(">h", _exact(f, 2))
        if columns == -1:
            return None
        if columns != 1:
            raise FramingError(f"one column expected, {columns} found")
        (size,) = struct.unpack(">i", _exact(f, 4))
        return Frame(f.tell(), size)
    if framing == "gossip_store":
        header = f.read(12)
        if not header:
            return None
        if len(header) < 12:
            raise FramingError("a record header is cut short")
        flags, size, crc, ts = struct.unpack(">HHII", header)
        return Frame(f.tell(), size, flags, crc, ts) if size else None
    size = _varint(f, "big" if framing == "gsp" else "little")
    if not size or (framing == "varint" and size == 1):
        return None
    return Frame(f.tell(), size)


#: Stands where a file breaks off.
BROKEN = Frame(-1, -1)
#: Bytes of the longest message that a row can hold.
LONGEST = (1 << 31) - 1
#: The length of a file that is read as a stream: its end shows where a message is short.
UNKNOWN = 1 << 62


def hop(f: BinaryIO, framing: str, length: int, failfast: bool = False, mark: bool = False) -> Iterator[Frame]:
    """Frames from the stream's place on, without reading messages; ``length`` is the file's, or UNKNOWN.

    Where the file breaks its format or ends inside a message, FramingError is raised with ``failfast``; else frames end there, with
    BROKEN as the last one if it is to be marked.
    """
    while True:
        try:
            frame = _next(f, framing)
            if frame is None:
                return
            if frame.at + max(frame.size, 0) > length or frame.size > LONGEST:
                raise FramingError("a message is cut short")
        except FramingError:
            if failfast:
                raise
            if mark:
                yield BROKEN
            return
        if frame.size >= 0:
            yield frame
            f.seek(frame.at + frame.size)


def messages(f: BinaryIO, framing: str, length: int, failfast: bool = False, mark: bool = False) -> Iterator[tuple[Frame, bytes | None]]:
    """(frame, message) from the stream's place on; (BROKEN, None) marks where the file breaks off, if it is to be marked."""
    for frame in hop(f, framing, length, failfast, mark):
        if frame is BROKEN:
            yield frame, None
            return
        f.seek(frame.at)
        msg = f.read(frame.size)
        if len(msg) < frame.size:
            if failfast:
                raise FramingError("a message is cut short")
            if mark:
                yield BROKEN, None
            return
        yield frame, msg


def write_varint(n: int) -> bytes:
    if n < 0xFD:
        return bytes([n])
    for mark, width in ((0xFD, 2), (0xFE, 4), (0xFF, 8)):
        if n < 1 << 8 * width:
            return bytes([mark]) + n.to_bytes(width, "little")
    raise ValueError("varint out of range")


def frame_all(items: Iterable[bytes], framing: str, version: int = 0x0C, ts: int = 0) -> Iterator[bytes]:
    """The bytes of a file that holds the messages, in parts."""
    if framing == "pgcopy":
        yield PGCOPY_SIGNATURE + struct.pack(">II", 0, 0)
        for m in items:
            yield struct.pack(">hi", 1, len(m)) + m
        yield struct.pack(">h", -1)
    elif framing == "gossip_store":
        import zlib

        yield bytes([version])
        for m in items:
            yield struct.pack(">HHII", 0, len(m), zlib.crc32(m), ts) + m
    elif framing in ("varint", "gsp"):
        if framing == "gsp":
            yield GSP_MAGIC
        for m in items:
            size = write_varint(len(m))
            yield (size if framing == "varint" else size[:1] + size[:0:-1]) + m
    else:
        raise ValueError(f"framing is one of {FRAMINGS}, not {framing!r}")
