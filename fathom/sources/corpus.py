"""The corpus: text files as rows (path, text), and the table of files derived from it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.config import Config
from fathom.functions import paths, text


def discovered(root: str) -> list[str]:
    """Repositories under a folder: itself if it is one, else its children that are, else itself."""
    if os.path.isdir(os.path.join(root, ".git")):
        return [root]
    inside = sorted(e.path for e in os.scandir(root) if e.is_dir() and os.path.isdir(os.path.join(e.path, ".git"))) if os.path.isdir(root) else []
    return inside or [root]


def load(spark: SparkSession, roots: list[str], config: Config = Config()) -> DataFrame:
    """path, text, size, mtime of the readable files under roots; with several roots, paths begin with the root's name.

    Files are listed and read by Spark, so roots may lie in any store that it reads; oversized files, skipped folders and unknown extensions are
    dropped before their content is decoded.
    """
    wanted = sorted(set(paths.LANGUAGES) | {k.lstrip(".").lower() for k in config.extra_extensions})
    out = None
    for root in roots:
        base = root.rstrip("/")
        name = base.split("/")[-1]
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        inside = F.regexp_replace("path", rf"^.*?{_quoted(base)}/", "")
        found = found.where(F.col("length") <= config.max_file_bytes).withColumn("_inside", inside)
        found = found.where(~F.arrays_overlap(F.split("_inside", "/"), F.array(*[F.lit(d) for d in config.skip_dirs])))
        found = found.where(paths.extension(F.col("_inside")).isin(wanted) & (paths.extension(F.col("_inside")) != "pdf"))
        place = F.concat(F.lit(f"{name}/"), F.col("_inside")) if len(roots) > 1 else F.col("_inside")
        one = found.select(place.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        one = one.select("path", F.coalesce("text", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), "size", "mtime")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no roots")
    return out


def _quoted(base: str) -> str:
    return "\\Q" + base.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def with_tests(corpus: DataFrame, config: Config = Config()) -> DataFrame:
    """path, text, is_test: what extraction reads."""
    return corpus.select("path", "text", paths.is_test(F.col("path"), config.test_patterns, config.production_patterns).alias("is_test"))


def files(corpus: DataFrame, config: Config = Config()) -> DataFrame:
    """path, module, lang, hash, lines, size, mtime, is_test of a corpus (path, text, and size and mtime where known)."""
    known = corpus.columns
    size = F.col("size").cast("long") if "size" in known else F.octet_length("text").cast("long")
    mtime = F.col("mtime") if "mtime" in known else F.lit(None).cast("timestamp")
    path = F.col("path")
    return corpus.select(
        "path", text.module_of(path).alias("module"), paths.language(path, config.extra_extensions).alias("lang"), F.sha1(F.col("text").cast("binary")).alias("hash"),
        text.line_count(F.col("text")).alias("lines"), size.alias("size"), mtime.alias("mtime"), paths.is_test(path, config.test_patterns, config.production_patterns).alias("is_test"),
    )
