"""Corpus, search and text operators over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import paths, text
from fathom.operators import graph, search
from fathom.plans.registry import plan
from fathom.sources import corpus

#: a document's place in the corpus: its source is the module, its language the extension
PATH_SQL = "concat(source, '/', CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE 'docs/' END, doc_id, '.', CASE lang WHEN 'en' THEN 'md' WHEN 'fr' THEN 'py' WHEN 'de' THEN 'java' ELSE 'ts' END)"
LANG_SQL = "CASE lang WHEN 'en' THEN 'docs' WHEN 'fr' THEN 'python' WHEN 'de' THEN 'java' ELSE 'typescript' END"
CHUNK_SQL = f"""lines AS (SELECT {PATH_SQL} AS path, string_split(text, chr(10)) AS l FROM documents),
 cut AS (SELECT path, l, unnest(range(0, len(l), 40)) AS i FROM lines),
 chunks AS (SELECT path, i + 1 AS start_line, array_to_string(l[i + 1 : i + 40], chr(10)) AS content FROM cut WHERE regexp_replace(array_to_string(l[i + 1 : i + 40], ''), '\\s+', '', 'g') <> '')"""


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    suffix = F.when(F.col("lang") == "en", "md").when(F.col("lang") == "fr", "py").when(F.col("lang") == "de", "java").otherwise("ts")
    folder = F.when(F.col("doc_id") % 7 == 0, "tests/").otherwise("docs/")
    return docs.select(F.concat(F.col("source"), F.lit("/"), folder, F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"), "text", "doc_id")


@plan(
    f"""SELECT {PATH_SQL} AS path, source AS module, {LANG_SQL} AS lang, sha1(text) AS hash, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS lines,
 CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id % 7 = 0 AS is_test FROM documents"""
)
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(document_corpus(spark, sf_dir)).select("path", "module", "lang", "hash", "lines", "size", "is_test")


@plan(
    f"""WITH f AS (SELECT source AS dir, {LANG_SQL} AS lang, count(*) AS n FROM documents GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, lang) AS k FROM f)
SELECT dir, CAST(sum(n) AS BIGINT) AS files, string_agg(lang, ',' ORDER BY k) FILTER (WHERE k <= 3) AS langs FROM r GROUP BY dir"""
)
def module_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_map(corpus.files(document_corpus(spark, sf_dir)))


@plan(f"SELECT source AS module, sha1(string_agg(sha1(text), '|' ORDER BY {PATH_SQL})) AS hash FROM documents GROUP BY source")
def module_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_hash(corpus.files(document_corpus(spark, sf_dir)))


@plan(f"WITH {CHUNK_SQL} SELECT path, CAST(start_line AS INT) AS start_line, md5(content) AS content_md5 FROM chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.chunks(document_corpus(spark, sf_dir))
    return found.select("path", F.col("start_line").cast("int").alias("start_line"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@plan(
    f"""WITH {CHUNK_SQL}, c AS (SELECT *, CAST((length(content) - length(replace(lower(content), 'ention', ''))) / 6 AS INT) AS f,
 greatest(length(path) - 2, 0) + greatest(length(content) - 2, 0) AS d FROM chunks),
 s AS (SELECT count(*) AS n, avg(d) AS a, count_if(f > 0) AS h FROM c)
SELECT path, CAST(start_line AS INT) AS start_line, f, round(-greatest(ln((n - h + 0.5) / (h + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a)), 9) AS rank
FROM c, s WHERE f > 0"""
)
def search_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk that holds the phrase, with its rank."""
    found = search.ranked(search.chunks(document_corpus(spark, sf_dir)), "ention")
    return found.select("path", F.col("start_line").cast("int").alias("start_line"), F.col("f").cast("int").alias("f"), F.round("rank", 9).alias("rank"))


@plan(
    f"""WITH {CHUNK_SQL}, t AS (SELECT unnest(['onand', 'ention', 'thati']) AS term), c AS (SELECT *, greatest(length(path) - 2, 0) + greatest(length(content) - 2, 0) AS d FROM chunks),
 o AS (SELECT path, start_line, d, term, CAST((length(content) - length(replace(lower(content), term, ''))) / length(term) AS INT) AS f FROM c, t),
 s AS (SELECT term, count(*) AS n, avg(d) AS a, count_if(f > 0) AS h FROM o GROUP BY term),
 r AS (SELECT path, start_line, -greatest(ln((n - h + 0.5) / (h + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a)) AS rank FROM o JOIN s USING (term) WHERE f > 0),
 g AS (SELECT path, start_line, sum(rank) AS rank FROM r GROUP BY ALL),
 k AS (SELECT path, 41 - row_number() OVER (ORDER BY round(rank, 9), path, start_line) AS points FROM g QUALIFY points > 0)
SELECT path, CAST(sum(points) AS BIGINT) AS points FROM k GROUP BY path"""
)
def plan_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files for a task: its terms' best 40 chunks give 40, 39, ... points to their files."""
    from pyspark.sql import Window

    found = search.chunks(document_corpus(spark, sf_dir))
    best = search.search_any(found, ["onand", "ention", "thati"], 40).withColumn("rank", F.round("rank", 9))
    points = best.select("path", (F.lit(41) - F.row_number().over(Window.orderBy("rank", "path", "start_line"))).alias("points"))
    return points.groupBy("path").agg(F.sum("points").cast("long").alias("points"))


@plan(
    """WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9_.$-]{3,}'), lambda x: x NOT IN (%s)) AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_slice(list_distinct_ordered, 1, 8), ' ') AS terms FROM (
 SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM w)"""
    % ", ".join(f"'{w}'" for w in text.STOP_WORDS)
)
def task_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", F.array_join(text.task_terms(F.col("text")), " ").alias("terms"))


@plan("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%d_w%' ORDER BY p_name, p_partkey LIMIT 30")
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.where(text.like_folded(F.col("p_name"), "%D_W%")).select("p_partkey", "p_name", "p_type").orderBy("p_name", "p_partkey").limit(30)



@plan(
    """SELECT page_id, CASE WHEN length(p) > 1 THEN rtrim(p, '/') ELSE p END AS norm FROM (
 SELECT page_id, regexp_replace(CASE WHEN starts_with(q, '/') THEN q ELSE '/' || q END, '/{2,}', '/', 'g') AS p FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://[^/]+', '', 'i'), '[?#].*$', '', 's'),
   '\\$\\{[^}]*\\}', '{}', 'g'), '\\{[^}]*\\}', '{}', 'g'), ':[A-Za-z0-9_]+', '{}', 'g') AS q FROM pages))"""
)
def http_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", paths.normalize_route(F.col("url")).alias("norm"))


@plan(
    """WITH s AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z]+', '_', 'g')) AS name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND name <> 'stock' THEN name || ',stock' ELSE name END AS tables, CASE WHEN p_partkey % 3 = 0 THEN 'read' ELSE 'write' END AS mode FROM s"""
)
def sql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and modes of statements made from part names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.regexp_replace("p_name", "[^A-Za-z]+", "_")
    kinds = [F.concat(F.lit("SELECT * FROM shop."), name, F.lit(" JOIN stock ON true")), F.concat(F.lit("update "), name, F.lit(" set a = 1")), F.concat(F.lit("delete from "), name)]
    made = F.when(F.col("p_partkey") % 3 == 0, kinds[0]).when(F.col("p_partkey") % 3 == 1, kinds[1]).otherwise(kinds[2])
    return part.select("p_partkey", F.array_join(text.sql_tables(made), ",").alias("tables"), text.sql_mode(made).alias("mode"))
