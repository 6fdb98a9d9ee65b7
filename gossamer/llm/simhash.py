"""SimHash near-duplicates by bit-sliced comparison.

Every whole text gets a 64-bit fingerprint; equal fingerprints collapse before anything is compared, pigeonhole
cells bring together all fingerprints that may be close, each cell compares its bit planes with carry-save counters,
and the links (fewer than the rows of a cell) join into connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.checkpoints import checkpoint
from gossamer.llm.bitslice import links
from gossamer.llm.common import id_text, quoted, record_batch, slices, table
from gossamer.llm.pigeonhole import cells
from gossamer.operators.components import connected_components

#: Hashes whose bits are counted at one time.
VOTES = 1 << 15
#: Rows of whole cells that are compared in one batch.
BATCH_ROWS = 1 << 16


def majority(hashes: list[int]) -> int:
    """The number whose bit is 1 where it is in over half of the 64-bit hashes; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), VOTES):
        part = np.array(hashes[at : at + VOTES], dtype=np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle_words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased; fewer words make one shingle, and none give 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(b" ".join(words), seed)
    return majority([digest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(shingle_words)))])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for every row of docs; a null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            yield record_batch(schema, [ids, _signed([fingerprint(x, shingle_words, seed) for x in texts])])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints from rows (cell, fp) sorted by cell; a cell is never cut."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(parts: list) -> pa.RecordBatch:
        cell, prints = (np.concatenate(x) for x in zip(*parts))
        pairs = np.array(links(prints.view(np.uint64), cell, radius), dtype=np.int64).reshape(-1, 2)
        return record_batch(schema, [prints[pairs[:, 0]], prints[pairs[:, 1]]])

    for batch in batches:
        cell, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(cell):
            continue
        if sum(len(c) for c, _ in held) >= BATCH_ROWS:
            cut = int(np.searchsorted(cell, held[-1][0][-1], side="right"))
            held.append((cell[:cut], prints[:cut]))
            if cut < len(cell):
                yield flush(held)
                held = [(cell[cut:], prints[cut:])]
        else:
            held.append((cell, prints))
    if held:
        yield flush(held)


def close_links(prints: DataFrame, radius: int) -> DataFrame:
    """(src, dst) between distinct fingerprints of column ``fp`` that connect all that lie within the radius."""
    found = cells(prints, prints.count(), radius).select("cell", "fp")
    dealt = found.repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(lambda it: linked(it, radius), "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    ``component_id`` is the smallest doc_id that the document reaches over links of at most ``radius`` differing
    bits, itself included. Texts without words have fingerprint 0 and link like any other; a null text counts as empty;
    equal rows get equal results; a null doc_id is kept, and counts for no component's smallest id. An empty table gives no rows.
    """
    prints = checkpoint(fingerprints(docs, shingle_words, seed))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = connected_components(checkpoint(close_links(prints.select("fp").distinct(), radius)))
    known = first.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = known.join(smallest, "component").select("fp", "component_id")
    return prints.join(by_print, "fp", "left").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; edge cases as in ``near_duplicates``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of docs that come first, by doc_id, in their group of near-duplicates; all columns stay.

    All rows of a doc_id that comes first stay. Rows without a doc_id stay, as nothing names them. Columns may have any names.
    """
    kept = near_duplicates(docs, radius).where("doc_id = component_id").select("doc_id").distinct()
    own = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("own"), F.col("doc_id").cast("long").alias("doc_id"))
    return own.join(kept, "doc_id", "left_semi").unionByName(own.where("doc_id is null")).select("own.*")
