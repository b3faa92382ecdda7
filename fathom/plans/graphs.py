"""Graph operators over the foreign keys of the star schema: every row is a node, every reference an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import graph
from fathom.plans.registry import plan

KEYS = [
    ("lineitem", "concat_ws('-', l_orderkey, l_linenumber)", "orders", "l_orderkey"),
    ("lineitem", "concat_ws('-', l_orderkey, l_linenumber)", "part", "l_partkey"),
    ("lineitem", "concat_ws('-', l_orderkey, l_linenumber)", "supplier", "l_suppkey"),
    ("orders", "o_orderkey", "customer", "o_custkey"),
    ("customer", "c_custkey", "nation", "c_nationkey"),
    ("supplier", "s_suppkey", "nation", "s_nationkey"),
    ("nation", "n_nationkey", "region", "n_regionkey"),
]
EDGES_SQL = "WITH RECURSIVE edges AS (" + " UNION ALL ".join(
    f"SELECT concat('{a}/', {k}) AS src, concat('{b}/', {v}) AS dst FROM {a}" for a, k, b, v in KEYS
) + ")"


def foreign_keys(spark: SparkSession, sf_dir: str, tables: set[str] | None = None) -> DataFrame:
    """src, dst, kind: an edge for each reference."""
    out = None
    for source, key, target, reference in KEYS:
        if tables and source not in tables:
            continue
        one = spark.read.parquet(f"{sf_dir}/{source}.parquet").select(
            F.concat(F.lit(f"{source}/"), F.expr(key).cast("string")).alias("src"), F.concat(F.lit(f"{target}/"), F.col(reference).cast("string")).alias("dst"), F.lit("ref").alias("kind")
        )
        out = one if out is None else out.unionByName(one)
    return out


@plan(EDGES_SQL + " SELECT dst AS path, count(*) AS dependents FROM edges GROUP BY dst ORDER BY dependents DESC, path LIMIT 30")
def fk_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hotspots(foreign_keys(spark, sf_dir), 30)


@plan(EDGES_SQL + " SELECT DISTINCT dst FROM edges WHERE src = 'supplier/1'")
def fk_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependencies(foreign_keys(spark, sf_dir), "supplier/1")


@plan(
    EDGES_SQL
    + """, l1 AS (SELECT DISTINCT src FROM edges WHERE dst = 'region/1'),
 l2 AS (SELECT DISTINCT e.src FROM edges e JOIN l1 ON e.dst = l1.src),
 l3 AS (SELECT DISTINCT e.src FROM edges e JOIN (SELECT src FROM l2 EXCEPT SELECT src FROM l1) f ON e.dst = f.src)
SELECT 1 AS depth, split_part(src, '/', 1) AS node_type, count(*) AS nodes FROM l1 GROUP BY ALL
UNION ALL SELECT 2, split_part(src, '/', 1), count(*) FROM l2 GROUP BY ALL
UNION ALL SELECT 3, split_part(src, '/', 1), count(*) FROM l3 GROUP BY ALL"""
)
def fk_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = spark.createDataFrame([("region/1",)], "path string")
    reached = graph.blast_radius(foreign_keys(spark, sf_dir), root, 3)
    return reached.groupBy("depth", F.split_part("path", F.lit("/"), F.lit(1)).alias("node_type")).agg(F.count("*").alias("nodes"))


@plan(EDGES_SQL + " SELECT split_part(src, '/', 1) AS src_module, split_part(dst, '/', 1) AS dst_module, count(*) AS n FROM edges GROUP BY ALL")
def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_edges(foreign_keys(spark, sf_dir))
