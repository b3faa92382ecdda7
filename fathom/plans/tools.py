"""The engine's questions over code written from the tables (see `code`): what they must answer follows from the rows, so SQL can say it without reading any code."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.engine import Engine
from fathom.operators import graph, memory, seams
from fathom.plans.code import FILE_SQL, NEXT_SQL, PATH_SQL, TEST_SQL, code
from fathom.plans.registry import plan
from fathom.scratch import shared_dir, written
from fathom.sources import corpus, sidecars


def engine(spark: SparkSession, sf_dir: str, **more) -> Engine:
    return Engine(code(spark, sf_dir).select("path", "text"), **more)


def stored(spark: SparkSession, sf_dir: str) -> Engine:
    """The same with its tables written, for questions that read many of them, but not chunks."""
    return engine(spark, sf_dir).stored(f"{shared_dir(spark)}/fathom/{spark.sparkContext.applicationId}/code-{uuid.uuid4().hex}", lazy=["chunks"])


PARTS = f"WITH f AS (SELECT p_partkey AS p, p_size, {NEXT_SQL} AS j, {PATH_SQL} AS path, {TEST_SQL} AS is_test FROM part)"
IMPORTS = f"e AS (SELECT path AS src, {FILE_SQL.format(p='j')} AS dst FROM f WHERE j % 5 <> 0 AND j <> p AND j IN (SELECT p FROM f))"


@plan(f"{PARTS} SELECT concat('read', p) AS caller, concat('Part', p) AS parent, path, 7 AS line FROM f WHERE p_size = 5 ORDER BY path LIMIT 100")
def find_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).find_callers("lookup5", 100)


@plan("SELECT unnest(['query', 'send']) AS callee, 8 AS line FROM part WHERE p_partkey = 8")
def find_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).find_callees("send8")


@plan(f"{PARTS} SELECT concat('Part', p) AS name, 'class' AS kind, path, 5 AS line FROM f WHERE concat('Part', p) ILIKE '%rt12%' ORDER BY name, path LIMIT 30")
def find_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).find_symbol("RT12").select("name", "kind", "path", "line")


@plan(f"{PARTS}, {IMPORTS} SELECT dst AS path, count(*) AS dependents FROM e GROUP BY dst ORDER BY dependents DESC, path LIMIT 30")
def import_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).hotspots(30)


@plan(
    f"""{PARTS}, {IMPORTS}, l1 AS (SELECT DISTINCT src FROM e WHERE dst = {FILE_SQL.format(p=8)}), l2 AS (SELECT DISTINCT e.src FROM e JOIN l1 ON e.dst = l1.src)
SELECT src AS path, 1 AS depth, contains(src, '/test/') AS is_test FROM l1 UNION ALL SELECT src, 2, contains(src, '/test/') FROM l2"""
)
def import_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = engine(spark, sf_dir)
    return graph.blast_radius(written(built.tables["edges"], "edges"), spark.range(1).select(F.expr(FILE_SQL.format(p=8)).alias("path")), 2, built.tables["files"].where("is_test"))


@plan(
    f"""{PARTS}, {IMPORTS}, k AS (SELECT * FROM f WHERE p = 8)
SELECT 'file' AS part, path AS said FROM k UNION ALL SELECT 'module', 'svc1' FROM k UNION ALL SELECT 'messaging', unnest([concat('topic.', p % 50), concat('topic.', (p + 1) % 50)]) FROM k
UNION ALL SELECT 'database', concat('table_', p_size) FROM k UNION ALL SELECT 'outline', unnest([concat('Part', p, ':5'), concat('read', p, ':7'), concat('send', p, ':8'), concat('on', p, ':9')]) FROM k
UNION ALL SELECT 'defines', concat('GET /api/b', p_size, '/items/{{}}/', p) FROM k
UNION ALL SELECT 'dependents', CAST((SELECT count(DISTINCT src) FROM e WHERE dst = k.path) AS VARCHAR) FROM k"""
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the engine tells about one class."""
    pack = stored(spark, sf_dir).context_pack("Part8")
    rows = [("file", pack["file"]), ("module", pack["module"]), *[("messaging", t) for t in pack["messaging"]], *[("database", t) for t in pack["database"]]]
    rows += [("outline", f"{s['name']}:{s['line']}") for s in pack["outline"]] + [("defines", f"{e['method']} {e['norm']}") for e in pack["http"]["defines"]]
    return spark.createDataFrame([*rows, ("dependents", str(pack["blast_radius"]["direct_dependents"]))], "part string, said string")


@plan(
    f"""{PARTS}, {IMPORTS}, k AS (SELECT * FROM f WHERE p IN (6, 8, 10, 12))
SELECT path, unnest([concat('produce topic.', p % 50), concat('consume topic.', (p + 1) % 50), concat('read table_', p_size), concat('GET /api/b', p_size, '/items/{{}}/', p),
 concat('dependents ', (SELECT count(*) FROM e WHERE dst = k.path))]) AS touched FROM k
UNION ALL SELECT DISTINCT '', concat('drift table_', p_size) FROM k WHERE NOT is_test AND p_size NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT '', concat('uncalled /api/b', p_size, '/items/{{}}/', p) FROM k WHERE NOT is_test AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k.p AND s_suppkey % 50 + 1 = k.p_size)"""
)
def change_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edit of four files touches."""
    built = stored(spark, sf_dir)
    paths = [r[0] for r in spark.range(20).where("id in (6, 8, 10, 12)").select(F.expr(FILE_SQL.format(p="id"))).collect()]
    found = built.change_check(paths)
    rows = [(f["path"], t) for f in found["per_file"] for t in (*f["messaging"], *f["database"], *f["endpoints"], f"dependents {f['direct_dependents']}")]
    warned = found["seam_warnings"]
    rows += [("", f"drift {t}") for t in warned["drift_tables_touched"]] + [("", f"uncalled {n}") for n in warned["endpoints_with_no_caller"]]
    return spark.createDataFrame(rows, "path string, touched string")


@plan(
    f"""{PARTS} SELECT path, concat('table_', p_size) AS tbl, 'read' AS mode, 'static' AS source, is_test FROM f
UNION ALL SELECT path, concat('legacy_', p_size), 'write', concat('asserted:a', p % 3), is_test FROM f WHERE p % 4 = 0"""
)
def provenance_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses that code shows, and those that people assert, in one table."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 4 = 0")
    none = {c: F.lit(None).cast(k).alias(c) for c, k in (x.replace("`", "").split() for x in sidecars.ASSERTION.split(", "))}
    said = none | {
        "kind": F.lit("db").alias("kind"), "file": F.expr(PATH_SQL).alias("file"), "line": F.lit(1).alias("line"), "table": F.expr("concat('Legacy_', p_size)").alias("table"),
        "mode": F.lit("write").alias("mode"), "author": F.expr("concat('a', p_partkey % 3)").alias("author"),
    }
    return engine(spark, sf_dir, assertions=part.select(*said.values())).tables["db_access"].select("path", "tbl", "mode", "source", "is_test")


@plan(
    f"""{PARTS}, own AS (SELECT concat('table_', p_size) AS tbl, count_if(NOT is_test) AS reads, count_if(is_test) AS tests FROM f GROUP BY ALL), d AS (SELECT concat('table_', n_nationkey) AS tbl FROM nation)
SELECT coalesce(own.tbl, d.tbl) AS tbl, coalesce(reads, 0) AS reads, coalesce(tests, 0) AS tests,
 CASE WHEN d.tbl IS NULL AND reads > 0 THEN 'accessed but not defined' WHEN d.tbl IS NULL THEN 'accessed but not defined (tests only)' WHEN coalesce(reads, 0) = 0 THEN 'defined but never accessed' ELSE '' END AS warning
FROM own FULL JOIN d ON own.tbl = d.tbl"""
)
def code_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).tables
    return seams.table_sides(t["db_defs"], t["db_access"]).select("tbl", "reads", "tests", "warning").na.fill("", ["warning"])


@plan(
    """SELECT DISTINCT concat('supplier/', l_suppkey) AS src, concat('part/', l_partkey) AS dst, 'ref' AS kind FROM lineitem"""
)
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiler's index in which every part is defined in a file of its own and suppliers refer to the parts they supply."""
    part, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    symbol = lambda c: F.concat(F.lit("part/"), F.col(c).cast("string"))
    defs = part.select(symbol("p_partkey").alias("symbol"), symbol("p_partkey").alias("path"), F.lit(1).alias("line"))
    refs = items.select(symbol("l_partkey").alias("symbol"), F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_linenumber").alias("line"))
    return sidecars.reference_edges(defs, refs)


@plan(
    """WITH o AS (SELECT concat('D', o_orderkey) AS id, lag(concat('D', o_orderkey)) OVER w AS supersedes, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS decided_at FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT a.id, CASE WHEN b.id IS NULL THEN 'accepted' ELSE 'superseded' END AS status, coalesce(b.id, '') AS superseded_by, coalesce(b.decided_at, '') AS valid_until FROM o a LEFT JOIN o b ON b.supersedes = a.id"""
)
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a decision that supersedes its customer's last one."""
    from pyspark.sql import Window

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("id", F.expr("concat('D', o_orderkey)"))
    last = F.lag("id").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    made = orders.select("id", last.alias("supersedes"), F.to_date("o_orderdate").cast("string").alias("decided_at"), F.lit("accepted").alias("status"))
    return memory.superseded(made).select("id", "status", "superseded_by", "valid_until").na.fill("", ["superseded_by", "valid_until"])


@plan(
    """WITH f AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation)
SELECT concat('f', k) AS feature, CAST(k + r + 2 AS BIGINT) AS total, CAST(k AS BIGINT) AS done, CAST(r AS BIGINT) AS doing, CAST(1 AS BIGINT) AS blocked, CAST(round_even(k * 100.0 / (k + r + 2), 0) AS INT) AS percent FROM f"""
)
def feature_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checklist for each nation."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = F.expr("concat(repeat('- [x] a\n', n_nationkey), repeat('* [~] b\n', n_regionkey), '- [!] c\n- [ ] d\n')")
    files = nation.select(F.expr("concat('docs/features/f', n_nationkey, '/tasks.md')").alias("path"), text.alias("text"))
    return sidecars.progress(files).select("feature", "total", "done", "doing", "blocked", "percent")


@plan(f"{PARTS} SELECT 'svc' || (p % 7) AS module, count(*) AS files FROM f GROUP BY ALL UNION ALL SELECT 'web', count(*) FROM supplier UNION ALL SELECT 'db', count(*) FROM nation")
def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(code(spark, sf_dir)).groupBy("module").agg(F.count("*").alias("files"))
