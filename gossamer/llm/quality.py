"""Quality rules by compression bands.

A text whose zstandard ratio (bytes over compressed bytes) leaves the band for its length is rejected: above it the
text repeats itself, below it it does not compress as language does. Whole texts have a band by length, and
fixed chunks of longer texts have one band, so that a repetitive or random stretch shows in a text that is fine on the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from gossamer.llm.common import id_text, record_batch, slices, table

WINDOW = 8
SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Bands:
    """Limits on the ratio. Each band: (length in bytes up to which it holds, lowest ratio, highest ratio).

    ``lowest`` are (length in bytes, lowest ratio) between random printable words and prose of that length, met by straight lines
    between them; the greater of it and of the band's own holds. Up to 60 bytes the two do not differ, and random lower-case words
    differ from prose from 1,500 bytes on only. Long texts share more with themselves, so their upper limits are wider.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = ((100, 0.0, 2.2), (300, 0.5, 2.4), (1_000, 0.9, 2.6), (4_000, 1.2, 2.9), (16_000, 1.4, 3.2), (float("inf"), 1.5, 3.6))
    lowest: tuple[tuple[float, float], ...] = ((60, 0.0), (100, 0.953), (200, 1.14), (300, 1.2), (500, 1.32), (1_000, 1.5), (1_500, 1.67), (2_000, 1.71), (3_000, 1.75), (4_000, 1.77))
    chunk_bytes: int = 4_096
    chunk: tuple[float, float] = (1.77, 4.5)
    #: Share of a text's chunks that may leave the chunk band.
    chunk_share: float = 0.25


def ratios(data: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """The ratio of the whole and of each chunk of a text longer than one; the last chunk ends where the text ends and may reach back
    into the one before it. An empty text has ratio 1."""
    if not data:
        return 1.0, []
    size = bands.chunk_bytes
    starts = [*range(0, len(data) - size, size), len(data) - size] if len(data) > size else []
    parts = [data[i : i + size] for i in starts]
    return len(data) / len(compressor.compress(data)), [size / len(compressor.compress(p)) for p in parts]


def verdict(n_bytes: int, whole: float, chunks: list[float], bands: Bands) -> str:
    """``fine``, ``repetitive`` or ``incompressible``."""
    low, high = next((low, high) for most, low, high in bands.whole if n_bytes <= most)
    low = max(low, float(np.interp(n_bytes, *zip(*bands.lowest))))
    if whole > high:
        return "repetitive"
    if n_bytes and whole < low:
        return "incompressible"
    if sum(c > bands.chunk[1] for c in chunks) > bands.chunk_share * len(chunks):
        return "repetitive"
    if sum(c < bands.chunk[0] for c in chunks) > bands.chunk_share * len(chunks):
        return "incompressible"
    return "fine"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that occurs twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    # a hash tells texts without repeats; exact ranks of pairs, fours and eights decide the others
    mixed = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    if len(np.unique(mixed)) == n:
        return 0
    rank, width = ids, 1
    while width < window:
        step = min(width, window - width)
        _, rank = np.unique(rank[: len(rank) - step] * (len(words) + 1) + rank[step:], return_inverse=True)
        width += step
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    """(words, characters in words, symbols, lines with a word that equal an earlier line, words in repeated windows)."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    seen: set[bytes] = set()
    repeated = 0
    for line in data.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.split(None, 1):
            seen.add(line)
    chars = len(b"".join(words).decode("utf-8"))
    return len(words), chars, len(SYMBOLS.findall(text)), repeated, repeated_words(words)


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Measures and verdict of every row of docs.

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, n_chunks, compression, kept). A
    null text counts as empty, and fails for want of words; repeated rows get equal results; an empty table gives no rows.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema(
        [(n, pa.int64()) for n in names] + [("base_failed", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("compression", pa.string()), ("kept", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for ids, texts in slices(batches):
            columns: list[list] = [[] for _ in range(len(schema) - 1)]
            for text in texts:
                text = text or ""
                found = measures(text)
                failed = found[0] < 20 or 100 * found[4] > 30 * found[0]
                data = text.encode("utf-8", "replace")
                whole, chunks = ratios(data, bands, compressor)
                says = verdict(len(data), whole, chunks, bands)
                for column, value in zip(columns, (*found, failed, whole, len(chunks), says, not failed and says == "fine")):
                    column.append(value)
            yield record_batch(schema, [ids, *columns])

    ddl = ", ".join(f"{n} long" for n in names) + ", base_failed boolean, ratio double, n_chunks long, compression string, kept boolean"
    return id_text(docs).mapInArrow(run, ddl)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; edge cases as in ``judge``."""
    return judge(table(spark, sf_dir, "documents"))
