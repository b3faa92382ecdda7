"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone: no ring table, no counts, no other row. With one shard more, a row
either stays or moves into the new shard, and about one in n+1 rows moves.

Slots number a shard's rows without gaps. They come from two levels, so that no task sorts a whole shard: rows fall into cells (shard, part of the
hash of their place in the reading), a small table of cell counts gives every cell its first slot, and rows are numbered inside cells. The number of cells follows the
number of rows, and neither a hot key nor a hot row fills one. The placed rows are written, without texts, so texts are read once.

Defined cases: a null key counts as the hash of a null, so such rows share a shard; a null text has no bytes; repeated keys share a shard and have slots of
their own; an empty table gives no rows; only key and text are read, and `written_shards` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

SHARDS = 40
CELL_ROWS = 20_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: the last of the jumps, drawn from a linear congruential generator, that lands under `shards`."""
    if shards < 1:
        raise ValueError("at least one shard")
    state = keys.astype(np.uint64).copy()
    shard, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        shard[going] = ahead[going]
        with np.errstate(over="ignore"):
            state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
        spread = (state[going] >> np.uint64(33)).astype(np.float64) + 1
        ahead[going] = ((shard[going] + 1) * (float(1 << 31) / spread)).astype(np.int64)
        going = going[ahead[going] < shards]
    return shard.astype(np.int32)


def jump_column(key_hash: Column, shards: int) -> Column:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("int")
    def placed(h: pa.Array) -> pa.Array:
        return pa.array(jump(np.asarray(h).view(np.uint64), shards), pa.int32())

    return placed(key_hash)


def assigned(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    total = docs.count()
    parts = max(1, -(-total // (shards * CELL_ROWS)))
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))

    def run(batches):
        for batch in batches:
            h = np.asarray(batch.column(3)).view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(jump(h, shards), pa.int32()), pa.array(jump(h, shards + 1), pa.int32())], [*batch.schema.names, "shard", "grown_shard"]
            )

    placed = hashed.mapInArrow(run, "doc_id long, size long, text_crc32 long, h long, shard int, grown_shard int").drop("h")
    placed, _ = written(placed.withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size", "place")
    numbered = placed.withColumn("rank", F.row_number().over(inside) - 1).join(firsts, ["shard", "cell"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), "grown_shard"
    )


def written_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", column: str = "shard") -> None:
    """All columns of docs as Parquet, in a folder for each shard."""
    docs.withColumn(column, jump_column(F.xxhash64(F.col(key).cast("long")), shards)).write.partitionBy(column).parquet(path)
