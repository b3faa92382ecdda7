"""Extraction over code written from the tables: a Java class for each part, a TypeScript file for each supplier, a change log for each nation.

What must be found follows from the rows, so SQL can say it without reading any code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import paths
from fathom.operators import seams
from fathom.operators.extract import run
from fathom.plans.registry import plan
from fathom.scratch import written
from fathom.sources import corpus

NEXT_SQL = "(p_partkey * 7) % 1000 + 1"
FILE_SQL = """CASE WHEN {p} % 5 = 0 THEN concat('svc', {p} % 7, '/src/test/java/shop/svc', {p} % 7, '/Part', {p}, 'Test.java') ELSE concat('svc', {p} % 7, '/src/main/java/shop/svc', {p} % 7, '/Part', {p}, '.java') END"""
PATH_SQL = FILE_SQL.format(p="p_partkey")
TEST_SQL = "p_partkey % 5 = 0"


CODED = [("part", "p_partkey", "p_size"), ("supplier", "s_suppkey"), ("nation", "n_nationkey", "n_regionkey")]
SLICE = 5_000  # files read by a task


def sliced(rows: DataFrame, key: str) -> DataFrame:
    """Rows spread over tasks by their number: keys weigh nothing in Parquet, the files written from them do."""
    slices = rows.count() // SLICE + 1
    return rows.repartition(slices, key) if slices > 1 else rows


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text, is_test."""
    part, supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*columns) for t, *columns in CODED)
    part, supplier = sliced(part, "p_partkey"), sliced(supplier, "s_suppkey")
    java = part.select(
        F.expr(PATH_SQL).alias("path"),
        F.concat(
            F.expr(f"concat('package shop.svc', p_partkey % 7, ';\nimport shop.svc', ({NEXT_SQL}) % 7, '.Part', {NEXT_SQL}, ';\n@RestController\n')"),
            F.expr("concat('@RequestMapping(\"/api/b', p_size, '\")\npublic class Part', p_partkey, ' {\n  static final String TOPIC_', p_partkey, ' = \"topic.', p_partkey % 50, '\";\n')"),
            F.expr("concat('  @GetMapping(\"/items/{id}/', p_partkey, '\") public String read', p_partkey, '(String id) { return lookup', p_size, '(id); }\n')"),
            F.expr("concat('  void send', p_partkey, '() { kafkaTemplate.send(TOPIC_', p_partkey, ', x); jdbcTemplate.query(\"SELECT * FROM table_', p_size, ' WHERE a = 1\", m); }\n')"),
            F.expr("concat('  @KafkaListener(topics = \"topic.', (p_partkey + 1) % 50, '\") void on', p_partkey, '(String s) {}\n')"),
            F.expr("CASE WHEN p_partkey % 5 = 0 THEN concat('  @Test void checks', p_partkey, '() { read', p_partkey, '(\"a\"); }\n}\n') ELSE '}\n' END"),
        ).alias("text"),
    )
    web = supplier.select(
        F.expr("concat('web/src/s', s_suppkey, '.ts')").alias("path"), F.expr("concat('// client\nfetch(`$', '{BASE}/api/b', s_suppkey % 50 + 1, '/items/$', '{id}/', s_suppkey, '`, { method: ''GET'' });\n')").alias("text")
    )
    schema = nation.select(
        F.expr("concat('db/changelog/n', n_nationkey, '.xml')").alias("path"),
        F.expr("concat('<databaseChangeLog>\n<changeSet id=\"', n_nationkey, '\" author=\"r', n_regionkey, '\"><createTable tableName=\"Table_', n_nationkey, '\"/></changeSet></databaseChangeLog>')").alias("text"),
    )
    out = java.unionByName(web).unionByName(schema)
    return out.withColumn("is_test", paths.is_test(F.col("path")))


def facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    found = code(spark, sf_dir)
    return run.seams(found)


def once(tables: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """Tables of which some, those that a plan reads many times, are written."""
    return tables | {n: written(tables[n], n) for n in names}


@plan(
    f"""WITH f AS (SELECT p_partkey AS p, {PATH_SQL} AS path, {TEST_SQL} AS is_test FROM part)
SELECT path, concat('Part', p) AS name, 'class' AS kind, 5 AS line, '' AS parent FROM f
UNION ALL SELECT path, concat('read', p), 'method', 7, concat('Part', p) FROM f UNION ALL SELECT path, concat('send', p), 'method', 8, concat('Part', p) FROM f
UNION ALL SELECT path, concat('on', p), 'method', 9, concat('Part', p) FROM f UNION ALL SELECT path, concat('checks', p), 'method', 10, concat('Part', p) FROM f WHERE is_test"""
)
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.structure(code(spark, sf_dir))["symbols"].select("path", "name", "kind", "line", F.coalesce("parent", F.lit("")).alias("parent"))


@plan(
    f"""WITH f AS (SELECT p_partkey AS p, p_size, {PATH_SQL} AS path, {TEST_SQL} AS is_test FROM part)
SELECT path, concat('read', p) AS caller, concat('lookup', p_size) AS callee, 7 AS line FROM f
UNION ALL SELECT path, concat('send', p), unnest(['send', 'query']), 8 FROM f UNION ALL SELECT path, concat('checks', p), concat('read', p), 10 FROM f WHERE is_test"""
)
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.structure(code(spark, sf_dir))["calls"].select("path", "caller", "callee", "line")


@plan(
    f"""WITH f AS (SELECT p_partkey AS p, {NEXT_SQL} AS j, {PATH_SQL} AS src FROM part)
SELECT src, {FILE_SQL.format(p="j")} AS dst, 'import' AS kind FROM f WHERE j % 5 <> 0 AND j <> p AND j IN (SELECT p_partkey FROM part)"""
)
def code_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code(spark, sf_dir)
    return run.import_edges(run.structure(found)["imports"], corpus.files(found))


@plan(f"SELECT {PATH_SQL} AS path, concat('checks', p_partkey) AS name, 10 AS line FROM part WHERE {TEST_SQL}")
def code_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.structure(code(spark, sf_dir))["test_cases"].select("path", "name", "line")


@plan(
    f"""SELECT {PATH_SQL} AS path, {TEST_SQL} AS is_test, concat('topic.', p_partkey % 50) AS topic, 'produce' AS direction, 8 AS line, true AS resolved, concat('TOPIC_', p_partkey) AS via, 'kafka' AS system FROM part
UNION ALL SELECT {PATH_SQL}, {TEST_SQL}, concat('topic.', (p_partkey + 1) % 50), 'consume', 9, true, '', 'kafka' FROM part"""
)
def code_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir)["msg_edges"].na.fill("", ["via"]).drop("source")


@plan(f"SELECT {PATH_SQL} AS path, {TEST_SQL} AS is_test, 'GET' AS method, concat('/api/b', p_size, '/items/{{}}/', p_partkey) AS norm, 7 AS line, 'Spring @GetMapping' AS detail FROM part")
def code_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir)["http_endpoints"].drop("route", "source")


@plan(
    f"SELECT {PATH_SQL} AS endpoint, concat('web/src/s', s_suppkey, '.ts') AS caller FROM part JOIN supplier ON p_partkey = s_suppkey AND p_size = s_suppkey % 50 + 1"
)
def code_http_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = once(facts(spark, sf_dir), "http_endpoints", "http_calls")
    return seams.called(found["http_endpoints"], found["http_calls"]).select(F.col("e_path").alias("endpoint"), F.col("c_path").alias("caller"))


@plan(f"SELECT {PATH_SQL} AS path, {TEST_SQL} AS is_test, concat('table_', p_size) AS tbl, 'sql' AS kind, 'read' AS mode, 8 AS line, 'JdbcTemplate.query' AS detail FROM part")
def code_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir)["db_access"].drop("source")


@plan("SELECT concat('db/changelog/n', n_nationkey, '.xml') AS path, concat('table_', n_nationkey) AS tbl, 'create' AS op, 2 AS line, concat('r', n_regionkey, ':', n_nationkey) AS changeset FROM nation")
def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir)["db_defs"].drop("is_test")


@plan(f"SELECT {PATH_SQL} AS path, concat('table_', p_size) AS tbl FROM part WHERE NOT ({TEST_SQL}) AND p_size NOT IN (SELECT n_nationkey FROM nation)")
def code_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts(spark, sf_dir)
    return seams.drift_sites(found["db_defs"], found["db_access"]).select("path", "tbl")


@plan(
    f"""WITH d AS (SELECT concat('table_', n_nationkey) AS tbl FROM nation), e AS (SELECT p_partkey AS p, p_size, {PATH_SQL} AS path, {TEST_SQL} AS t FROM part)
SELECT 'endpoints_with_no_caller' AS category, concat('GET /api/b', p_size, '/items/{{}}/', p) AS subject, path, 7 AS line FROM e
 WHERE NOT t AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p AND s_suppkey % 50 + 1 = p_size)
UNION ALL SELECT 'tables_accessed_but_undefined', concat('table_', p_size), path, 8 FROM e WHERE NOT t AND concat('table_', p_size) NOT IN (SELECT tbl FROM d)"""
)
def code_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = once(facts(spark, sf_dir), "http_endpoints", "http_calls")
    found = seams.gaps(t["msg_edges"], t["msg_topics"], t["db_defs"], t["db_access"], t["http_endpoints"], t["http_calls"])
    return found.where("category not like 'topics_%'")
