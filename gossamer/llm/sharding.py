"""Random shards by a two-pass external shuffle.

Pass one scatters whole records into buckets that fit in memory, by a seeded hash; pass two shuffles each bucket by
Fisher-Yates and writes it. A record's place in the whole order is its bucket's start plus its place in the bucket,
and the order is cut into shards whose row counts differ by one at most (the ``rows`` law).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from gossamer.checkpoints import fresh_path
from gossamer.llm.common import quoted, table

SHARDS = 16
SEED = 20_240
#: Bytes of text that a bucket holds, about.
BUCKET_BYTES = 16 << 20
#: Parts that the buckets are dealt into at most, a run of buckets each: a task streams its part and holds one bucket at a time, and only
#: the row counts of parts come to the driver.
MOST_PARTS = 10_000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """The row at each of n places: from the last down, a place swaps with a uniform one at or before it."""
    draws = np.random.default_rng([seed, bucket]).random(max(n - 1, 0))
    swaps = (draws * np.arange(n, 1, -1)).astype(np.int64).tolist()
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), swaps):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffle_into_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> DataFrame:
    """Write docs to ``path`` as Parquet folders ``shard=0`` upward and return the files as a DataFrame.

    All columns of docs are written, with ``slot``, the row's place in its shard, gapless from 0 (a column of docs named
    ``shard`` or ``slot`` gets underscores behind its name until that is free). Row counts of shards differ by one at most. Null
    texts and ids are hashed like values; rows that repeat both id and text share a bucket, which a task holds whole, in any order among equals.
    An empty table gives empty shards. The order depends on the rows and the seed, not on partitions or retries.
    """
    spark = docs.sparkSession
    taken = {c.lower() for c in docs.columns}
    for name in docs.columns:
        if name.lower() in ("shard", "slot"):
            free = name + "_"
            while free.lower() in taken:
                free += "_"
            taken.add(free.lower())
            docs = docs.withColumnRenamed(name, free)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 64
    held_bytes = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-int(held_bytes) // bucket_bytes))
    per_part = -(-buckets // MOST_PARTS)
    parts = -(-buckets // per_part)
    # the columns of docs travel in one, where no name of theirs meets one from here
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text_col)), F.lit(buckets)).cast("long")
    inner = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("own"), bucket.alias("bucket"), F.floor(bucket / per_part).cast("int").alias("part"))
    rows = np.zeros(parts, dtype=np.int64)
    for r in inner.groupBy("part").agg(F.count("*").alias("n")).collect():
        rows[r["part"]] = r["n"]
    total = int(rows.sum())
    starts = np.concatenate([[0], np.cumsum(rows)[:-1]])
    firsts = np.array([-(-s * total // shards) for s in range(shards)], dtype=np.int64)
    plain = StructType([*docs.schema.fields, StructField("slot", LongType()), StructField("shard", LongType())])
    arrow = to_arrow_schema(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, begun = -1, -1  # the bucket, and the place of its first row in the whole order

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).flatten()
            order = pa.array(fisher_yates(whole.num_rows, seed, now))
            position = begun + np.arange(whole.num_rows)
            shard = position * shards // total
            columns = [whole.column(i).take(order) for i in range(whole.num_columns - 1)]
            columns += [pa.chunked_array([position - firsts[shard]]), pa.chunked_array([shard])]
            yield from pa.Table.from_arrays(columns, names=arrow.names).cast(arrow).to_batches(max_chunksize=2048)

        for batch in batches:
            if batch.num_rows and begun < 0:
                begun = int(starts[batch.column(1)[0].as_py() // per_part])
            bucket = batch.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
            for a, b in zip(edge[:-1], edge[1:]):
                if bucket[a] != now:
                    if held:
                        yield from flush()
                        begun += sum(h.num_rows for h in held)
                    held, now = [], int(bucket[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    dealt = inner.repartitionById(parts, F.col("part"))
    own = F.col("own").getField
    dealt = dealt.sortWithinPartitions("bucket", F.xxhash64(own("doc_id"), F.lit(seed)), own("doc_id"), own(text_col))
    dealt.select("own", "bucket").mapInArrow(run, plain).write.partitionBy("shard").parquet(path)
    return spark.read.schema(plain).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``rows``. A null text has size 1; edge cases as in ``shuffle_into_shards``."""
    docs = table(spark, sf_dir, "documents")
    out = shuffle_into_shards(docs.select("doc_id", "text"), fresh_path(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
