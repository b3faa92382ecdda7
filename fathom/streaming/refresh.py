"""Refresh: what changed between two snapshots, how far a change of shared names reaches, and the same as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_KEYS, LEAST_FULL, FULL_SHARE = 50, 50, 0.4


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between two tables of files (path, hash)."""
    a = old.select("path", F.col("hash").alias("_old"))
    b = new.select("path", F.col("hash").alias("_new"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def is_wide(changed: int, total: int) -> bool:
    """Whether so many files changed that a full build is cheaper."""
    return changed > max(LEAST_FULL, FULL_SHARE * total)


def changed_keys(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys that were added, dropped or given another value."""
    a, b = old.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    return a.join(b, key, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key)


def widened(corpus: DataFrame, keys: list[str]) -> DataFrame:
    """path of the files whose text holds one of the keys; all files if there are too many keys to look for."""
    if len(keys) > MOST_KEYS:
        return corpus.select("path")
    hit = F.lit(False)
    for k in keys:
        hit = hit | F.contains("text", F.lit(k))
    return corpus.where(hit).select("path")


def overwritten(old: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """A table of facts after a refresh: the rows of touched paths go, the fresh ones come."""
    return old.join(touched.select("path").distinct(), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def surviving(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Facts whose file is still there."""
    return facts.join(files.select("path"), "path", "left_semi")


def guarded(old_count: int, new_count: int) -> None:
    """Refuses to take an empty listing for the deletion of everything."""
    if old_count and not new_count:
        raise ValueError("the new listing is empty; nothing is pruned")


def continuous(stream: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Runs build on every micro-batch of changed files (path, text), each version of a file once."""
    hashed = stream.withColumn("hash", F.sha1(F.col("text").cast("binary"))).dropDuplicates(["path", "hash"])
    writer = hashed.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
