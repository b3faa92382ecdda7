"""Decisions, provenance, staleness and refresh operators over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import graph
from fathom.operators import memory as m
from fathom.plans.documents import PATH_SQL, document_corpus
from fathom.plans.registry import plan
from fathom.scratch import shared_dir
from fathom.sources import corpus
from fathom.streaming import refresh

CHAIN_SQL = """chain AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS decided_at,
 CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS valid_until FROM orders)"""


def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out = m.chained(orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate")
    return out.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("decided_at"), F.to_date("valid_until").alias("valid_until"))


@plan(
    f"""WITH {CHAIN_SQL} SELECT o_orderkey, o_custkey, CAST(decided_at AS VARCHAR) AS decided_at, coalesce(CAST(valid_until AS VARCHAR), '') AS valid_until
 FROM chain WHERE decided_at <= DATE '1996-07-01' AND (valid_until IS NULL OR valid_until > DATE '1996-07-01')"""
)
def decisions_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.as_of(order_chain(spark, sf_dir), F.lit("1996-07-01").cast("date"))
    return out.select("o_orderkey", "o_custkey", F.col("decided_at").cast("string").alias("decided_at"), F.coalesce(F.col("valid_until").cast("string"), F.lit("")).alias("valid_until"))


@plan(
    """WITH c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_custkey = 1),
 start AS (SELECT k FROM c ORDER BY o_orderkey LIMIT 1)
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(c.k - start.k AS INT) AS step FROM c, start"""
)
def decision_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of one customer's orders, each superseding the one before, seen from the one with the smallest key."""
    from pyspark.sql import Window

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    before = F.lag(F.col("o_orderkey").cast("string")).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    chain = orders.select(F.col("o_orderkey").cast("string").alias("id"), before.alias("supersedes"))
    first = orders.where("o_custkey = 1").agg(F.min("o_orderkey")).first()[0]
    return m.trace(chain, str(first))


@plan(
    f"""WITH a AS (SELECT l.doc_id, d.{'text'} AS text, sha1(d.text) AS now, CASE WHEN l.doc_id % 3 = 0 THEN sha1(upper(d.text)) ELSE sha1(d.text) END AS was FROM labels l LEFT JOIN documents d USING (doc_id))
SELECT doc_id, now IS NULL OR was <> now AS stale FROM a"""
)
def stale_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as assertions about documents, a third of them made from another text."""
    docs = document_corpus(spark, sf_dir).select("doc_id", "path", "text")
    claims = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").join(docs, "doc_id", "left")
    was = F.sha1(F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")).cast("binary"))
    files = docs.select("path", F.sha1(F.col("text").cast("binary")).alias("hash"))
    return m.stale(claims.select("doc_id", F.col("path").alias("file"), was.alias("source_hash")), files).select("doc_id", "stale")




@plan(
    f"""WITH o AS (SELECT {PATH_SQL} AS path, sha1(text) AS h FROM documents WHERE doc_id % 10 <> 1), n AS (SELECT {PATH_SQL} AS path, sha1(CASE WHEN doc_id % 10 = 3 THEN lower(text) ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.path = n.path WHERE o.h IS NULL OR n.h IS NULL OR o.h <> n.h"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the documents: the later lacks some, has others, and some are rewritten."""
    docs = document_corpus(spark, sf_dir)
    later = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.lower("text")).otherwise(F.col("text")))
    return refresh.snapshot_diff(corpus.files(docs.where("doc_id % 10 <> 1")), corpus.files(later.where("doc_id % 10 <> 2")))


@plan(
    f"""SELECT {PATH_SQL} AS path FROM documents WHERE contains(text, 'onand') OR contains(text, 'thelich') OR contains(text, 'queelle')"""
)
def config_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a change of three shared names reaches."""
    old = spark.createDataFrame([("onand", "1"), ("thelich", "2"), ("same", "3")], "key string, value string")
    new = spark.createDataFrame([("onand", "9"), ("queelle", "2"), ("same", "3")], "key string, value string")
    keys = [r["key"] for r in refresh.changed_keys(old, new).collect()]
    return refresh.widened(document_corpus(spark, sf_dir), sorted(keys))


@plan(
    """WITH marks AS (SELECT user_id, ts AS mark_ts, max(event_id) AS mark_id FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT e.event_id, coalesce(m.mark_id, -1) AS symbol FROM events e ASOF LEFT JOIN marks m ON e.user_id = m.user_id AND e.ts >= m.mark_ts WHERE e.event_type <> 'signup'"""
)
def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: each event lies under its user's last signup."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    marks = events.where("event_type = 'signup'").groupBy("user_id", F.col("ts").alias("mark_ts")).agg(F.max("event_id").alias("mark_id"))
    rows = events.where("event_type <> 'signup'").select("event_id", "user_id", "ts")
    found = graph.nearest_before(rows, marks, ["user_id"], "ts", "mark_ts", ["mark_id"])
    return found.select("event_id", F.coalesce("mark_id", F.lit(-1).cast("long")).alias("symbol"))


@plan(f"SELECT source AS module, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files, each version once, taken in micro-batches whose facts are kept."""
    import uuid

    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    base = f"{shared_dir(spark)}/fathom/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*").select(F.expr("concat(source, '/', doc_id)").alias("path"), "text")

    def keep(batch: DataFrame, number: int) -> None:
        corpus.files(batch).select("path", "module", F.length("hash").alias("n")).join(batch.select("path", F.length("text").alias("chars")), "path").write.mode("overwrite").parquet(f"{base}/facts/batch={number}")

    refresh.continuous(stream, keep, f"{base}/state").awaitTermination()
    facts = spark.read.schema("path string, module string, n int, chars int").parquet(f"{base}/facts")
    return facts.groupBy("module").agg(F.count("*").alias("files"), F.sum("chars").alias("chars"))
