"""Cells of fingerprints that may lie within a radius, bounded in size whatever the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.checkpoints import checkpoint
from gossamer.llm.bitslice import scheme

#: Rows of one table and key that are compared in one piece; fuller keys are cut into chunks and met chunk by chunk.
CHUNK_ROWS = 8192


def _key(prints: Column, parts: list[tuple[int, int]]) -> Column:
    out, used = F.lit(0).cast("long"), 0
    for first, bits in parts:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(prints, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")), used))
        used += bits
    return out


#: Hash places that keys are counted in, for each table, at least; one for each PLACE_ROWS rows beyond.
PLACES, PLACE_ROWS = 1 << 14, 4096
#: Over-full places up to which the table of them is broadcast (24 bytes each); a longer one is joined by a shuffle.
BROADCAST_PLACES = 100_000


def cells(prints: DataFrame, n: int, radius: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``prints`` (with a long column ``fp``) once per cell that a row belongs to, the cell as long ``cell``.

    Any two rows within the radius share a cell at least. Keys are counted by hash place, which combines before its shuffle;
    the keys of a place with ``chunk_rows`` more rows than twice the average, which is PLACE_ROWS at most, are cut by hash into chunks, and
    each pair of chunks is a cell of its own. So no cell holds more than about two chunks and two average places, and a hot key spreads over
    many tasks; a key of m rows takes m * m / chunk_rows rows then. Different keys may share a ``cell`` hash, which costs comparisons and
    loses nothing.
    """
    tables = [F.struct(F.lit(t).alias("t"), _key(F.col("fp"), parts).alias("key")) for t, parts in enumerate(scheme(n, radius))]
    return keyed_cells(prints, F.array(*tables), n, chunk_rows)


def keyed_cells(prints: DataFrame, tables: Column, n: int, chunk_rows: int = CHUNK_ROWS, deal: str = "fp") -> DataFrame:
    """The same for keys of any kind: ``tables`` is an array of structs of a table ``t`` and a long ``key`` in it; ``deal`` is the column
    whose hash deals rows into chunks."""
    at = F.explode(tables).alias("__at")
    name = F.xxhash64("__at.t", "__at.key")
    places = max(PLACES, 1 << (n // PLACE_ROWS).bit_length())
    full = checkpoint(
        prints.select(at).groupBy(F.col("__at.t").alias("__t"), F.pmod(name, F.lit(places)).alias("__place"))
        .agg(F.count("*").alias("__size")).where(F.col("__size") > chunk_rows + 2 * n // places)
        .select("__t", "__place", F.ceil(F.col("__size") / chunk_rows).cast("int").alias("__chunks"))
    )
    spread = prints.select("*", at).select(*prints.columns, F.col("__at.t").alias("__t"), name.alias("__name"), F.pmod(name, F.lit(places)).alias("__place"))
    chunks = F.coalesce("__chunks", F.lit(1))
    cut = F.broadcast(full) if full.count() <= BROADCAST_PLACES else full
    paired = spread.join(cut, ["__t", "__place"], "left").withColumn("__own", F.pmod(F.xxhash64(deal, F.lit(7)), chunks).cast("int"))
    paired = paired.withColumn("__other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    cell = F.xxhash64("__name", F.least("__own", "__other"), F.greatest("__own", "__other"))
    return paired.select(*prints.columns, cell.alias("cell"))
