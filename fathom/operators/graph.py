"""The graph of files: edges (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import like_folded
from fathom.scratch import written


def hotspots(edges: DataFrame, limit: int = 10) -> DataFrame:
    """path, dependents: nodes with the most incoming edges, of all kinds."""
    counted = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("dependents"))
    return counted.orderBy(F.col("dependents").desc(), "path").limit(limit)


def dependencies(edges: DataFrame, path: str) -> DataFrame:
    """dst: what a node points to."""
    return edges.where(F.col("src") == path).select("dst").distinct()


def dependents(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("dst") == path).select("src").distinct()


def blast_radius(edges: DataFrame, roots: DataFrame, depth: int = 2, tests: DataFrame | None = None, repeats: bool = True) -> DataFrame:
    """path, depth, is_test: what reaches the roots (path) within `depth` steps against the edges.

    repeats: each level lists all sources of its frontier, also those met before, as the interactive tool reports them; otherwise a node appears at
    its first level only, and never a root. Each level is one join of the edges with a written frontier, at most five of them, so the plan grows by one join a level;
    frontiers are broadcast only where Spark measures them small.
    """
    depth = max(1, min(depth, 5))
    pairs = edges.select("src", "dst")
    frontier = roots.select("path").distinct()
    seen, levels = frontier, []
    for level in range(1, depth + 1):
        found = pairs.join(frontier, pairs["dst"] == frontier["path"]).select(F.col("src").alias("path")).distinct()
        known = seen.select("path", F.lit(True).alias("_met"))
        found = written(found.join(known, "path", "left").select("path", F.col("_met").isNull().alias("_new")), "level")
        new = found.where("_new").select("path")
        levels.append((found.select("path") if repeats else new).withColumn("depth", F.lit(level)))
        if level < depth and new.isEmpty():
            break
        frontier, seen = new, seen.union(new)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    if tests is None:
        return out.withColumn("is_test", F.lit(False))
    marked = tests.select("path").distinct().withColumn("is_test", F.lit(True))
    return out.join(marked, "path", "left").na.fill(False, ["is_test"]).select("path", "depth", "is_test")


def module_map(files: DataFrame, prefix: str = "", most: int = 3) -> DataFrame:
    """dir, files, langs: the next path segment under a prefix, its files, and its commonest languages."""
    under = files.where(like_folded(F.col("path"), f"{prefix}/%")) if prefix else files
    rest = F.expr(f"substring(path, {len(prefix) + 2 if prefix else 1})")
    segment = F.when(F.contains(rest, F.lit("/")), F.split_part(rest, F.lit("/"), F.lit(1))).otherwise(F.lit("(root files)"))
    counted = under.select(segment.alias("dir"), "lang").groupBy("dir", "lang").agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "lang")))
    grouped = counted.groupBy("dir").agg(F.sum("n").alias("files"), F.slice(ranked, 1, most).alias("top"))
    return grouped.select("dir", "files", F.array_join(F.transform("top", lambda t: t["lang"]), ",").alias("langs"))


def module_edges(edges: DataFrame) -> DataFrame:
    """src_module, dst_module, n: edges between different modules."""
    module = [F.split_part(F.col(c), F.lit("/"), F.lit(1)).alias(f"{c}_module") for c in ("src", "dst")]
    return edges.select(*module).where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.count("*").alias("n"))


def module_hash(files: DataFrame) -> DataFrame:
    """module, hash: SHA-1 of its files' hashes in path order, joined by |. The text that is hashed stands in one row: 41 bytes a file, so 41 MB for a module of a million files."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "hash"))), lambda x: x["hash"])
    return files.groupBy("module").agg(F.sha1(F.array_join(ordered, "|").cast("binary")).alias("hash"))


def first_claim(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def nearest_before(rows: DataFrame, marks: DataFrame, key: list[str], at: str, mark_at: str, keep: list[str], fill: str = "left") -> DataFrame:
    """As-of join: for each row the mark of its key with the largest mark_at that is not beyond at.

    Rows and marks are ordered together within a key in one window pass; a mark stands before a row at the same place.
    """
    both = rows.select(*[F.col(c) for c in rows.columns], F.col(at).alias("_at"), F.lit(1).alias("_kind"))
    mark = marks.select(*key, F.struct(F.col(mark_at), *keep).alias("_mark"), F.col(mark_at).alias("_at"), F.lit(0).alias("_kind"))
    w = Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.unionByName(mark, allowMissingColumns=True).withColumn("_last", F.last("_mark", ignorenulls=True).over(w)).where("_kind = 1")
    out = out.select(*rows.columns, *[F.col(f"_last.{c}").alias(c) for c in [mark_at, *keep] if c not in rows.columns])
    return out if fill == "left" else out.where(F.col(keep[0]).isNotNull())
