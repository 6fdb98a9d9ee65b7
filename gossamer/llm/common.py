"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose Python objects exist at one time; the Arrow batch itself stays a buffer.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: further columns, whatever they are called, never meet an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[tuple[pa.Array, list]]:
    """(ids as Arrow, texts as Python) for a few rows at a time; a null text stays None."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).to_pylist()


def text_batches(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about so many bytes of text, or one row; a batch without rows gives none."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, before + chars, side="right")), at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()  # workers are reused, and the next operator's memory comes on top


def quoted(name: str) -> str:
    """A column's name as it stands, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
