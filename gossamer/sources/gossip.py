"""Message files as DataFrames.

``spark.read.format("gossip")`` reads files that every executor can open, and cuts large ones into byte ranges. ``read_binary`` reads any
store that Spark reads, a file to a task. Both give (file, ord, msg, rec_flags, rec_crc, rec_ts); ``ord`` counts through the files in
order of their paths, 2**40 apart.
"""

from __future__ import annotations

import glob
import io
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

from gossamer.schemas import RAW_DDL
from gossamer.sources.framing import FRAMINGS, UNKNOWN, FramingError, begin, detect, frame_all, hop, messages

#: Messages of an Arrow batch.
BATCH = 10_000
#: Bytes of a part of a file, about.
PART_BYTES = 64 << 20
FILE_ORD = 40

_ARROW = pa.schema([("file", pa.string()), ("ord", pa.int64()), ("msg", pa.binary()), ("rec_flags", pa.int32()), ("rec_crc", pa.int64()), ("rec_ts", pa.int64())])


def _paths(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(p for p in (os.path.join(path, x) for x in os.listdir(path)) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))
    return sorted(glob.glob(path)) or ([path] if os.path.exists(path) else [])


def _framing(option: str, head: bytes) -> str:
    return detect(head) if option == "auto" else option


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


class Part(InputPartition):
    """The messages of a file from byte ``at`` on, ``n`` of them at most; the first is number ``first`` of its file."""

    def __init__(self, path: str, file: int, framing: str, at: int, first: int, n: int):
        self.path, self.file, self.framing, self.at, self.first, self.n = path, file, framing, at, first, n


class GossipReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}  # names of options have no case
        self.path = options.get("path", "")
        self.framing = options.get("framing", "auto")
        self.start = int(options.get("startord", "0"))
        self.skip_version = options.get("skipversionbyte", "true").lower() == "true"
        self.failfast = options.get("mode", "FAILFAST").upper() == "FAILFAST"
        self.part_bytes = int(options.get("partbytes", str(PART_BYTES)))
        if self.framing not in (*FRAMINGS, "auto"):
            raise ValueError(f"framing is auto or one of {FRAMINGS}, not {self.framing!r}")

    def partitions(self) -> list[Part]:
        """Headers alone are read here; a missing path has no parts."""
        out = []
        for number, path in enumerate(_paths(self.path)):
            length = os.path.getsize(path)
            with open(path, "rb") as f:
                framing = _framing(self.framing, f.read(11))
                f.seek(0)
                if not length:
                    continue
                begin(f, framing, self.skip_version)
                place, first, n = f.tell(), 0, 0
                if length > self.part_bytes:
                    for frame in hop(f, framing, length):
                        n += 1
                        end = frame.at + frame.size
                        if end - place >= self.part_bytes:
                            out.append(Part(path, number, framing, place, first, n))
                            place, first, n = end, first + n, 0
                out.append(Part(path, number, framing, place, first, 1 << FILE_ORD))
        return out or [Part("", 0, "varint", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        def rows():
            if not partition.n:
                return
            length = os.path.getsize(partition.path)
            with open(partition.path, "rb") as f:
                f.seek(partition.at)
                for i, (frame, msg) in enumerate(messages(f, partition.framing, length, self.failfast, mark=True)):
                    if i >= partition.n:
                        return
                    if partition.first + i >= self.start:
                        yield partition.path, (partition.file << FILE_ORD) + partition.first + i, msg, frame.flags, frame.crc, frame.ts

        yield from _batches(rows())


class GossipStream(SimpleDataSourceStreamReader):
    """Follows files that grow: the offset is each file's byte and message count. A message that is not whole yet waits."""

    def __init__(self, options: dict):
        self.options = GossipReader(options)

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._from(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._from(start, end)[0])

    def _from(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        o, rows, reached = self.options, [], dict(start)
        for number, path in enumerate(_paths(o.path) if end is None else sorted(end)):
            place, count, framing = start.get(path, [0, 0, ""])
            with open(path, "rb") as f:
                if not framing:
                    framing = _framing(o.framing, f.read(11))
                    f.seek(0)
                    try:
                        begin(f, framing, o.skip_version)
                    except ValueError:
                        continue
                    place = f.tell()
                f.seek(place)
                length = end[path][0] if end is not None else os.path.getsize(path)
                for frame, msg in messages(f, framing, length):
                    rows.append((path, (number << FILE_ORD) + count, msg, frame.flags, frame.crc, frame.ts))
                    place, count = frame.at + frame.size, count + 1
            reached[path] = [place, count, framing]
        return rows, reached


class Written(WriterCommitMessage):
    """The attempt's file of a task that has ended well, and the name it gets with the job."""

    def __init__(self, attempt: str, name: str):
        self.attempt, self.name = attempt, name


class GossipWriter(DataSourceWriter):
    """One file for each partition, its messages in the order of its rows (column ``msg``).

    Files carry the job's name, so that an append replaces nothing. They appear when the job commits: an overwrite takes the older ones out
    then, and a job that fails leaves the folder as it was.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool = False):
        self.path, self.framing = options.get("path", "").removeprefix("file://"), options.get("framing", "varint")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex[:12]
        self.column = schema.fieldNames().index("msg")
        if self.framing not in FRAMINGS:
            raise ValueError(f"framing is one of {FRAMINGS}, not {self.framing!r}")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{context.partitionId():05d}-{self.job}.gossip")
        attempt = os.path.join(self.path, f"_{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}")
        with open(attempt, "wb") as f:
            for part in frame_all((bytes(r[self.column]) for r in rows), self.framing):
                f.write(part)
        return Written(attempt, name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite and os.path.isdir(self.path):
            for old in _paths(self.path):
                os.remove(old)
        for m in messages:
            if isinstance(m, Written):
                os.replace(m.attempt, m.name)
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Take out what attempts of this job have left."""
        for name in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if name.startswith(f"_{self.job}-"):
                os.remove(os.path.join(self.path, name))


class GossipSource(DataSource):
    """Options: path, framing (auto), startOrd, skipVersionByte, mode (FAILFAST or PERMISSIVE), partBytes.

    A file that ends inside a message or breaks its format fails the query; with PERMISSIVE it ends there with a row whose ``msg`` is NULL.
    """

    @classmethod
    def name(cls) -> str:
        return "gossip"

    def schema(self) -> str:
        return RAW_DDL

    def reader(self, schema: StructType) -> DataSourceReader:
        return GossipReader(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return GossipStream(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return GossipWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GossipSource)


def read_binary(spark: SparkSession, path: str, framing: str = "auto", skip_version: bool = True, failfast: bool = True, start: int = 0) -> DataFrame:
    """Message files from any store that Spark reads; a task holds one file. Files are numbered by their paths.

    A broken file fails the query; without ``failfast`` it ends there with a row whose ``msg`` is NULL."""
    return messages_of(spark.read.format("binaryFile").load(path), framing, skip_version, failfast, start)


#: Bytes of a piece of a file, about; Spark sends 10,000 of them at once from one step to the next.
PIECE_BYTES = 4 << 10
#: Bytes of a file that are read ahead.
AHEAD = 1 << 20


def _cut(parts: Iterable[bytes], size: int, leave: int) -> Iterator[bytes]:
    """The parts joined to pieces of ``size`` bytes or more, without the last ``leave`` bytes; an empty piece if there are none."""
    held, any_ = bytearray(), False
    for part in parts:
        held += part
        if len(held) >= size + leave:
            end = len(held) - leave
            yield bytes(held[:end])
            del held[:end]
            any_ = True
    rest = bytes(held[: max(len(held) - leave, 0)])
    if rest or not any_:
        yield rest


class _Joined(io.RawIOBase):
    """The pieces of a file as a stream that goes forward."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.place = pieces, b"", 0, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = 0) -> int:
        if whence or offset < self.place:
            raise io.UnsupportedOperation("this stream goes forward")
        while self.place < offset and self.readinto(memoryview(bytearray(min(offset - self.place, AHEAD)))):
            pass
        return self.place

    def readinto(self, b: memoryview) -> int:
        n = 0
        while n < len(b):
            if self.at >= len(self.held):
                self.held, self.at = next(self.pieces, None), 0
                if self.held is None:
                    self.held = b""
                    break
            part = self.held[self.at : self.at + len(b) - n]
            b[n : n + len(part)] = part
            n, self.at = n + len(part), self.at + len(part)
        self.place += n
        return n


def framed_files(messages: DataFrame, framing: str, leave: int = 0) -> DataFrame:
    """(path, file, piece, content): a file for each partition of messages (msg), in the order of its rows and numbered by it, in pieces that
    follow each other from number 0 on; the last ``leave`` bytes of each file are left out. A task holds some pieces at a time."""
    schema = pa.schema([("path", pa.string()), ("file", pa.int64()), ("piece", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (m for batch in batches for m in batch.column(0).to_pylist())
        number, first, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            n = len(held)
            columns = [f"part-{number:05d}"] * n, [number] * n, range(first, first + n), held
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for piece in _cut(frame_all(rows, framing), PIECE_BYTES, leave):
            held.append(piece)
            size += len(piece)
            if size >= AHEAD:
                yield out()
                first, held, size = first + len(held), [], 0
        if held:
            yield out()

    return messages.select("msg").mapInArrow(run, "path string, file long, piece long, content binary")


def messages_of(files: DataFrame, framing: str = "auto", skip_version: bool = True, failfast: bool = True, start: int = 0) -> DataFrame:
    """The messages of files (path, content); files are numbered by their paths.

    With columns ``file`` and ``piece`` a file has a number already, and may lie in several rows that follow each other in a partition, as
    ``framed_files`` gives them.
    """
    pieced = {"file", "piece"} <= set(files.columns)
    names = [] if pieced else sorted(r["path"] for r in files.select("path").collect())  # names alone
    number = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns)))
        ahead = next(parts, None)

        def pieces(name: str) -> Iterator[bytes]:
            """Those of the file that begins with the row ``ahead``."""
            nonlocal ahead
            expected = 0
            while ahead is not None and (not expected or ahead[2]):
                if ahead[0] != name or ahead[2] != expected:
                    raise FramingError(f"piece {expected} of {name!r} expected, {ahead[2]} of {ahead[0]!r} found")
                data, expected = ahead[1], expected + 1
                ahead = next(parts, None)
                yield data or b""

        def rows():
            while ahead is not None:
                name = ahead[0]
                file = ahead[3] if pieced else number[name]
                length = UNKNOWN if pieced else len(ahead[1] or b"")
                own = pieces(name)
                f = io.BufferedReader(_Joined(own), AHEAD)
                head = f.peek(11)[:11]
                if head:
                    kind = _framing(framing, head)
                    begin(f, kind, skip_version)
                    for i, (frame, msg) in enumerate(messages(f, kind, length, failfast, mark=True)):
                        if i >= start:
                            yield name, (file << FILE_ORD) + i, msg, frame.flags, frame.crc, frame.ts
                for _ in own:  # what stands behind the end that the format names
                    pass

        yield from _batches(rows())

    return files.select("path", "content", *(["piece", "file"] if pieced else [F.lit(0).cast("long")])).mapInArrow(run, RAW_DDL)


def raw_responses(files: DataFrame, as_json: bool = False) -> DataFrame:
    """(path, rendered): each file (path, content) as hex text, or as JSON of its hex and size."""
    data = F.lower(F.hex("content"))
    rendered = F.to_json(F.struct(data.alias("raw_data"), F.length("content").alias("size"))) if as_json else data
    return files.select("path", rendered.alias("rendered"))
