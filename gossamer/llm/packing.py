"""Packing token ids into fixed windows by minimum bin slack.

Each document is cut at the window length; its whole windows need no partner, and what is left of it is an item for
the packer. Spark counts the items by length, a table of at most ``capacity`` rows however large the corpus is. On those
counts the driver fills one window pattern after another: the longest item left, then the multiset of lengths that a
bitset subset-sum finds closest to the capacity, backtracked to counts and repeated while those last. Spark ranks the
items of each length, salted so that a hot length spreads, and the rank decides sequence and offset.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.checkpoints import checkpoint
from gossamer.llm.common import id_text, record_batch, slices, table

CAPACITY = 2048
#: The id after each document's own.
END_ID = 1
#: Parts of texts whose ids a Python worker remembers.
REMEMBERED = 200_000


#: White space behind white space, and a blank with none on either side.
_RUN, _ALONE = re.compile(r"\s\s|^\s|\s$"), re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian unsigned 32-bit bytes.

    The pre-tokenizer never joins what stands on both sides of a single blank between other characters, so the ids of
    the part that such a blank begins depend on that part alone and are remembered, in two generations. Runs of white
    space stay inside a part. Merging by the ranks of the vocabulary gives the ids that its merge list gives. ``added`` are strings that
    have an id as they stand, and that part a text before anything else; the longest one wins where several begin.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.added = {token: struct.pack("<I", i) for token, i in (added or {}).items()}
        self.parting = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if self.added else None

    def _encode(self, text: str) -> bytes:
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if self.parting and self.parting.search(text):
            return b"".join(self.added.get(part) or self.plain(part) for part in self.parting.split(text) if part)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added strings."""
        parts = _ALONE.split(text) if _RUN.search(text) else text.split(" ")
        first, rest = parts[0], parts[1:]
        known = self.known
        try:
            tail = b"".join(map(known.__getitem__, rest))
        except KeyError:
            if len(known) > REMEMBERED:
                self.before, self.known = known, {}
                known = self.known
            for p in rest:
                if p not in known:
                    known[p] = self.before.get(p) or self._encode(" " + p)
            tail = b"".join(map(known.__getitem__, rest))
        return self._encode(first) + tail


def byte_bpe(path: str | None = None, pattern: str | None = None, added: dict[str, int] | None = None) -> Callable[[], Encoder]:
    """Makes the encoder on a worker. Vocabulary file, pattern and added strings are those of ``byte_bpe_50k`` if none are given; the added
    ones are read here, once, and the file is found on the worker by its name."""
    if added is None:
        import public_tokenizers

        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}

    def make() -> Encoder:
        import public_tokenizers as known

        return Encoder(path or known.path("byte_bpe_50k.tiktoken"), pattern or known.PATTERN, added)

    return make


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, make: Callable[[], Encoder] | None = None, key: str = "byte_bpe_50k", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document cut at ``capacity`` ids: (doc_id, start, length, ids_crc32, doc_tokens[, ids]).

    The end id follows each document's ids, so an empty or null text has one id.
    """
    make = make or byte_bpe()
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS[key] if key in _ENCODERS else _ENCODERS.setdefault(key, make())
        for ids, texts in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(ids.to_pylist(), texts):
                own = encode(text or "") + end
                n = len(own) // 4
                for start in range(0, n, capacity):
                    part = own[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, part)[: len(fields) + with_ids])
            yield record_batch(schema, [list(c) for c in zip(*rows)] if rows else [[] for _ in schema])

    return id_text(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def fill(counts: list[int], capacity: int) -> list[int]:
    """How many of each length to take, ``counts[l]`` at most, for the largest sum up to ``capacity``; longer lengths first.

    Bit s of a Python integer says whether the sum s can be reached; each length enters in binary shares of its count,
    and the integers before every share lead back from the best sum to the counts.
    """
    reach, mask, shares = 1, (1 << capacity + 1) - 1, []
    for length in range(min(capacity, len(counts) - 1), 0, -1):
        left = min(counts[length], capacity // length)
        share = 1
        while left > 0 and not reach >> capacity:
            take = min(share, left)
            shares.append((reach, length, take))
            reach |= reach << length * take & mask
            left -= take
            share *= 2
        if reach >> capacity:
            break
    best = reach.bit_length() - 1
    out = [0] * len(counts)
    for before, length, take in reversed(shares):
        if not before >> best & 1:
            out[length] += take
            best -= length * take
    assert best == 0
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, per window, first sequence, offset in the window), by length and rank.

    Items of a length with ranks from ``first rank`` on go ``per window`` to a window, in windows from ``first
    sequence`` on. The plan depends on the counts by length only; its rows grow with the number of lengths and the
    logarithm of the counts.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    used, rows, sequence = [0] * (capacity + 1), [], 0
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            break
        counts[longest] -= 1
        need = fill(counts, capacity - longest)
        counts[longest] += 1
        need[longest] += 1
        times = min(counts[x] // k for x, k in enumerate(need) if k)
        offset = 0
        for length in range(capacity, 0, -1):
            if k := need[length]:
                rows.append((length, used[length], k, sequence, offset))
                used[length] += k * times
                counts[length] -= k * times
                offset += k * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(items: DataFrame, largest: int, total: int) -> DataFrame:
    """Items with ``rank``, 0 upward within each length. Long runs of one length are ranked by salt, then offset."""
    share = min(max(total // 512, 256), 100_000)
    salts = max(1, -(-largest // share))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return salted.withColumn("own", F.row_number().over(own)).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")


def pack(docs: DataFrame, make: Callable[[], Encoder] | None = None, key: str = "byte_bpe_50k", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it stands in its document and where in which sequence.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]). Sequences are numbered from 0 without
    gaps and filled from offset 0 without gaps. Empty and null texts have the end id alone; repeated rows and null
    doc_ids are documents like others; an empty table gives no rows. ``ids`` holds little-endian unsigned 32-bit ids.
    """
    cut = checkpoint(pieces(docs, make, key, capacity, end_id, with_ids))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    places = plan(histogram, capacity)
    keys = places[:, 0] << 44 | places[:, 1]
    names = [x for x in cut.columns] + ["sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = own["length"].to_numpy(), own["rank"].to_numpy()
            place = places[np.searchsorted(keys, length << 44 | rank, side="right") - 1] if len(rank) else places[:0]
            index = rank - place[:, 1]
            own["sequence_id"] = pa.array(place[:, 3] + index // np.maximum(place[:, 2], 1))
            own["offset"] = pa.array(place[:, 4] + index % np.maximum(place[:, 2], 1) * length)
            yield pa.RecordBatch.from_arrays([own[n] for n in names], names=names)

    fields = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return ranked(cut, max(histogram.values(), default=0), sum(histogram.values())).select(*cut.columns, "rank").mapInArrow(run, fields)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place, with the ids of byte_bpe_50k. Null texts count as empty; repeated rows are packed each."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
