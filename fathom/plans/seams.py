"""Seam operators: orders produce, line items consume; pages define routes, links call them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from fathom.operators import seams
from fathom.plans.registry import plan

MESSAGES_SQL = """edges AS (SELECT 'orders' AS path, 'order-' || o_orderkey AS topic, 'produce' AS direction, 1 AS line, o_orderstatus <> 'P' AS resolved, o_orderpriority = '5-LOW' AS is_test FROM orders
 UNION ALL SELECT 'lineitem', 'order-' || l_orderkey, 'consume', l_linenumber, true, l_returnflag = 'A' FROM lineitem)"""
SIDES_SQL = """sides AS (SELECT topic, count_if(direction = 'produce') AS producers, count_if(direction = 'consume') AS consumers, count_if(NOT resolved) AS unresolved,
 CASE WHEN count_if(direction = 'consume') = 0 THEN 'produced but never consumed' WHEN count_if(direction = 'produce') = 0 THEN 'consumed but never produced' END AS orphan
 FROM edges WHERE NOT is_test GROUP BY topic)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    common = [F.lit(None).cast("string").alias("via"), F.lit("kafka").alias("system"), F.lit("static").alias("source")]
    made = orders.select(
        F.lit("orders").alias("path"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("topic"), F.lit("produce").alias("direction"), F.lit(1).alias("line"),
        (F.col("o_orderstatus") != "P").alias("resolved"), (F.col("o_orderpriority") == "5-LOW").alias("is_test"), *common,
    )
    used = items.select(
        F.lit("lineitem").alias("path"), F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("topic"), F.lit("consume").alias("direction"), F.col("l_linenumber").alias("line"),
        F.lit(True).alias("resolved"), (F.col("l_returnflag") == "A").alias("is_test"), *common,
    )
    return made.unionByName(used)


@plan(f"WITH {MESSAGES_SQL}, {SIDES_SQL} SELECT topic, producers, consumers, unresolved, coalesce(orphan, '') AS orphan FROM sides")
def topic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seams.topic_sides(messages(spark, sf_dir)).drop("systems").na.fill("", ["orphan"])


@plan(
    f"WITH {MESSAGES_SQL} SELECT DISTINCT topic FROM edges WHERE direction = 'produce' AND NOT is_test AND topic NOT IN (SELECT topic FROM edges WHERE direction = 'consume' AND NOT is_test)"
)
def orphan_produce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seams.topic_sides(messages(spark, sf_dir)).where("orphan = 'produced but never consumed'").select("topic")


@plan(
    f"WITH {MESSAGES_SQL} SELECT DISTINCT topic FROM edges WHERE direction = 'consume' AND NOT is_test AND topic NOT IN (SELECT topic FROM edges WHERE direction = 'produce' AND NOT is_test)"
)
def orphan_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seams.topic_sides(messages(spark, sf_dir)).where("orphan = 'consumed but never produced'").select("topic")


@plan(
    f"""WITH {MESSAGES_SQL} SELECT topic, count_if(direction = 'produce' AND NOT is_test AND resolved) AS producers, count_if(direction = 'consume' AND NOT is_test AND resolved) AS consumers,
 count_if(is_test) AS test_usage, CASE WHEN producers > 0 AND consumers = 0 THEN 'produced but never consumed' WHEN consumers > 0 AND producers = 0 THEN 'consumed but never produced'
 WHEN producers + consumers + count_if(NOT is_test AND NOT resolved) = 0 THEN 'only tests use it' ELSE '' END AS warning FROM edges GROUP BY topic"""
)
def message_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seams.message_sites(messages(spark, sf_dir))
    counts = [F.col(f"n_{c}").alias(c) for c in ("producers", "consumers", "test_usage")]
    return found.select("topic", *counts, F.coalesce("warning", F.lit("")).alias("warning"))


@plan(
    f"""WITH {MESSAGES_SQL}, {SIDES_SQL} SELECT topic, consumers, coalesce(orphan, '') AS orphan FROM sides
 ORDER BY orphan IS NULL, consumers DESC, topic LIMIT 50"""
)
def budget_warn_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = seams.topic_sides(messages(spark, sf_dir)).select("topic", "consumers", "orphan")
    return seams.warned_first(sides, "orphan", [F.col("consumers").desc(), F.col("topic")], 50).na.fill("", ["orphan"])


DB_SQL = """defs AS (SELECT 'part-' || l_partkey AS tbl FROM lineitem WHERE l_returnflag = 'R'),
 access AS (SELECT 'part-' || l_partkey AS tbl, l_linestatus = 'F' AS is_test, CASE l_returnflag WHEN 'A' THEN 'read' ELSE 'write' END AS mode, l_orderkey || '-' || l_linenumber AS path, l_linenumber AS line FROM lineitem WHERE l_returnflag <> 'R')"""


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tbl = F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("tbl")
    defs = items.where("l_returnflag = 'R'").select(tbl)
    access = items.where("l_returnflag <> 'R'").select(
        tbl, (F.col("l_linestatus") == "F").alias("is_test"), F.when(F.col("l_returnflag") == "A", "read").otherwise("write").alias("mode"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("path"), F.col("l_linenumber").alias("line"),
    )
    return defs, access


@plan(
    f"""WITH {DB_SQL}, d AS (SELECT tbl, count(*) AS ops FROM defs GROUP BY tbl),
 a AS (SELECT tbl, count_if(NOT is_test AND mode = 'read') AS reads, count_if(NOT is_test AND mode = 'write') AS writes, count_if(is_test) AS tests, count_if(NOT is_test) AS live FROM access GROUP BY tbl)
SELECT coalesce(d.tbl, a.tbl) AS tbl, coalesce(ops, 0) AS ops, coalesce(reads, 0) AS reads, coalesce(writes, 0) AS writes, coalesce(tests, 0) AS tests,
 CASE WHEN ops IS NULL AND live > 0 THEN 'accessed but not defined' WHEN ops IS NULL THEN 'accessed but not defined (tests only)' WHEN coalesce(live, 0) = 0 THEN 'defined but never accessed' ELSE '' END AS warning
FROM d FULL JOIN a ON d.tbl = a.tbl"""
)
def table_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seams.table_sides(*tables(spark, sf_dir)).na.fill("", ["warning"])


NORM_SQL = """CASE WHEN length({0}) > 1 THEN rtrim({0}, '/') ELSE {0} END"""
RAW_SQL = """regexp_replace(CASE WHEN starts_with({0}, '/') THEN {0} ELSE '/' || {0} END, '/{{2,}}', '/', 'g')"""


def _norm_sql(raw: str) -> str:
    cut = f"regexp_replace(regexp_replace(trim({raw}), '^https?://[^/]+', '', 'i'), '[?#].*$', '', 's')"
    return RAW_SQL.format(f"regexp_replace({cut}, '[0-9]+', '{{}}', 'g')")


@plan(
    f"""WITH e AS (SELECT DISTINCT {_norm_sql("url")} AS norm FROM pages),
 c AS (SELECT DISTINCT {_norm_sql("link")} AS norm FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)),
 es AS (SELECT norm, list_filter(string_split(norm, '/'), lambda s: s <> '') AS p FROM e), cs AS (SELECT norm, list_filter(string_split(norm, '/'), lambda s: s <> '') AS p FROM c)
SELECT c.norm AS call, count(e.norm) AS endpoints FROM cs c LEFT JOIN es e ON len(c.p) = len(e.p)
 AND len(list_filter(range(1, len(c.p) + 1), lambda i: c.p[i] <> e.p[i] AND c.p[i] <> '{{}}' AND e.p[i] <> '{{}}')) = 0 GROUP BY c.norm"""
)
def http_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the pages' routes (numbers as parameters) each link can reach."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")

    def norm(c):
        cut = F.regexp_replace(F.regexp_replace(F.trim(c), "(?i)^https?://[^/]+", ""), r"(?s)[?#].*$", "")
        p = F.regexp_replace(cut, "[0-9]+", "{}")
        return F.regexp_replace(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)), "/{2,}", "/")

    get = [F.lit("GET").alias("method"), F.lit(False).alias("is_test")]
    endpoints = pages.select(norm(F.col("url")).alias("norm"), *get).distinct()
    link = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    calls = pages.select(link.alias("link")).select(norm(F.col("link")).alias("norm"), *get).distinct()
    hits = seams.called(endpoints, calls).groupBy(F.col("c_norm").alias("norm")).agg(F.count("*").alias("endpoints"))
    return calls.join(hits, "norm", "left").select(F.col("norm").alias("call"), F.coalesce("endpoints", F.lit(0).cast("long")).alias("endpoints"))


@plan(
    f"""WITH {MESSAGES_SQL}, {SIDES_SQL}, {DB_SQL}, used AS (SELECT DISTINCT topic FROM edges), declared AS (SELECT 'order-' || event_id AS topic, event_type AS path, 1 AS line FROM events)
SELECT DISTINCT 'unresolved_topic_expressions' AS category, topic AS subject, path, CAST(line AS INT) AS line FROM edges WHERE NOT is_test AND NOT resolved
UNION ALL SELECT DISTINCT 'topics_produced_but_never_consumed', e.topic, path, CAST(line AS INT) FROM edges e JOIN sides s USING (topic) WHERE NOT is_test AND direction = 'produce' AND orphan = 'produced but never consumed'
UNION ALL SELECT DISTINCT 'topics_consumed_but_never_produced', e.topic, path, CAST(line AS INT) FROM edges e JOIN sides s USING (topic) WHERE NOT is_test AND direction = 'consume' AND orphan = 'consumed but never produced'
UNION ALL SELECT DISTINCT 'tables_accessed_but_undefined', tbl, path, CAST(line AS INT) FROM access WHERE NOT is_test AND tbl NOT IN (SELECT tbl FROM defs)
UNION ALL SELECT DISTINCT 'endpoints_with_no_caller', 'GET /' || c_mktsegment, c_name, 1 FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT DISTINCT 'topics_declared_in_config_but_unused', topic, path, CAST(line AS INT) FROM declared WHERE topic NOT IN (SELECT topic FROM used)"""
)
def gaps_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs, access = tables(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    declared = events.select(F.concat(F.lit("order-"), F.col("event_id").cast("string")).alias("topic"), F.col("event_type").alias("path"), F.lit(1).alias("line"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    route = F.concat(F.lit("/"), "c_mktsegment")
    endpoints = customer.select(F.lit("GET").alias("method"), route.alias("norm"), F.col("c_name").alias("path"), F.lit(1).alias("line"), F.lit(False).alias("is_test"))
    calls = spark.createDataFrame([("GET", "/BUILDING", False), ("GET", "/{}/MACHINERY", False)], "method string, norm string, is_test boolean")
    return seams.gaps(messages(spark, sf_dir), declared, defs, access, endpoints, calls)
