"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Only where it is unset and Spark runs in one local JVM (tests) is a temporary folder made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="fathom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_SCRATCH: list[str] = []  # tables written and not dropped yet
_FOLDERS: set[str] = set()


def _forgotten(jvm, conf, folder: str) -> None:
    """Deletes the application's folder as Python ends, if the JVM still answers."""
    try:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the JVM has gone; what is left bears the application's id
        return


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes as the driver's Python ends."""
    folder = f"{shared_dir(spark)}/fathom/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_forgotten, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    return folder


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written once as Parquet into the shared folder, and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _SCRATCH:
            _SCRATCH.remove(path)


@contextmanager
def cleared(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """Drops what is written inside as the block ends, but for the paths that it adds to keep. Plans that read a dropped table can't run any more."""
    before = len(_SCRATCH)
    yield
    dropped(spark, *[p for p in _SCRATCH[before:] if p not in keep])


PAGE = 512  # rows of a file that a row of bits stands for
PAGE_BYTES = 128  # of such a row in a broadcast table, about
BITS_BYTES = 256_000_000  # broadcast at a time


def placed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), file and at: where each row lies in the files that docs reads. Tables that are no plain reading of Parquet files are written first."""
    nodes, todo = [], [docs._jdf.queryExecution().analyzed()]
    while todo:
        plan = todo.pop()
        nodes.append(plan.nodeName())
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    source = docs
    if not all(n in ("Project", "Filter", "SubqueryAlias") or n.startswith(("LogicalRelation", "Relation")) for n in nodes) or not docs.inputFiles():
        source, _ = written(docs, "rows")
    meta = source.metadataColumn("_metadata")
    return source.select(F.struct("*").alias("row"), F.xxhash64(meta.getField("file_path")).alias("file"), meta.getField("row_index").alias("at"))


def page_of() -> tuple[Column, Column, Column]:
    """Of a row at `at`: its page in the file, the word in the page, and its bit alone."""
    at = F.col("at").cast("long")
    return F.floor(at / PAGE), (F.floor(at / 64) % (PAGE // 64)).cast("int"), F.expr("shiftleft(1L, int(at % 64))")


def words_of(listed: Column) -> Column:
    """array<struct(word, bits)>, PAGE / 64 at most, as the page's words in order."""

    def at_word(i: Column) -> Column:
        return F.coalesce(F.get(F.transform(F.filter(listed, lambda x: x["word"] == i), lambda x: x["bits"]), F.lit(0)), F.lit(0).cast("long"))

    return F.transform(F.sequence(F.lit(0), F.lit(PAGE // 64 - 1)), at_word)


def is_marked(bits: str) -> Column:
    """Whether a row at `at` is marked in the column with its page's words (null: none are)."""
    _, word, bit = page_of()
    return F.coalesce(F.get(F.col(bits), word), F.lit(0).cast("long")).bitwiseAND(bit) != 0


def paged(rows: DataFrame, pages: DataFrame, size: int, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """use(rows with the columns of their page, null where there is none). rows: as placed(); pages: file, page and other columns, written, of about `size` bytes a row.

    The table is read with its pages broadcast, so no row is shuffled. Beyond BITS_BYTES of pages, files are taken in several passes, each with the pages of its files
    only, and what they give is written; a filter on the file's name keeps other files unread.
    """
    spark = rows.sparkSession
    passes = max(1, math.ceil(pages.count() * size / BITS_BYTES))
    names = [c for c in pages.columns if c not in ("file", "page")]

    def taken(some: DataFrame, of: DataFrame) -> DataFrame:
        asked, of = some.withColumn("page", page_of()[0]), of.select(F.col("file").alias("_file"), F.col("page").alias("_page"), *names)
        return use(asked.join(F.broadcast(of), (F.col("file") == F.col("_file")) & (F.col("page") == F.col("_page")), "left"))

    if passes == 1:
        return taken(rows, pages)
    path, schema = f"{scratch_dir(spark)}/paged-{uuid.uuid4().hex}", taken(rows, pages).schema
    for i in range(passes):
        mine = F.pmod(F.col("file"), F.lit(passes)) == i
        taken(rows.where(mine), pages.where(mine)).write.mode("append").parquet(path)
    _SCRATCH.append(path)
    return spark.read.schema(schema).parquet(path)


def chosen(rows: DataFrame, marked: DataFrame, keep: bool) -> DataFrame:
    """The rows of placed() that marked (file, at) names (keep), or that it doesn't; all columns of docs. Marks become pages of bits, aggregated from narrow rows."""
    page, word, bit = page_of()
    words = marked.select("file", page.alias("page"), word.alias("word"), bit.alias("bit")).groupBy("file", "page", "word").agg(F.bit_or("bit").alias("bits"))
    pages = words.groupBy("file", "page").agg(F.collect_list(F.struct("word", "bits")).alias("w")).select("file", "page", words_of(F.col("w")).alias("bits"))
    pages, _ = written(pages, "pages")
    told = is_marked("bits")
    return paged(rows, pages, PAGE_BYTES, lambda both: both.where(told if keep else ~told).select("row.*"))


HOT_KEYS = 1000


def joined(left: DataFrame, right: DataFrame, key: str, often: DataFrame, total: int) -> DataFrame:
    """left join right on key, inner, where right has one row a key and a key may hold a third of left.

    often: key, n (rows of left); total: rows of left. Keys with over a HOT_KEYS-th of all rows are HOT_KEYS at most: their rows meet a broadcast table and are not shuffled.
    """
    hot, _ = written(often.where(F.col("n") > max(1, total // HOT_KEYS)).select(key).join(right, key), "hot-keys")
    names = [c for c in right.columns if c != key]
    wide = hot.select(F.col(key).alias("_key"), F.struct(*names).alias("_hot"))
    told = left.join(F.broadcast(wide), left[key] == F.col("_key"), "left").drop("_key")
    columns = [F.col(c) for c in left.columns]
    here = told.where("_hot is not null").select(*columns, *[F.col(f"_hot.{c}").alias(c) for c in names])
    return told.where("_hot is null").select(*columns).join(right, key).select(*left.columns, *names).unionByName(here)


def bound(value: Column, use) -> Column:
    """use(v) with v evaluated once per row, even where use() refers to it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def under(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the first share of its range: the same rows wherever they lie, without sending any of the others."""
    return F.lit(True) if share >= 1 else hashed.bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(int(max(share, 0.0) * (1 << 63)))


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, and each row's start and length in them; null: empty. No copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    valid, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    size = np.diff(at)
    if column.null_count:
        size = np.where(np.asarray(column.is_valid()), size, 0)
    return raw, at[:-1], size
