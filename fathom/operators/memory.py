"""What a team knows beyond the code: decisions with their time of validity, assertions with their evidence, insights with their source's hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def superseded(decisions: DataFrame) -> DataFrame:
    """decisions (id, status, decided_at, supersedes) with valid_until, superseded_by: a successor ends its predecessor on the day it is decided."""
    later = decisions.where("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.max_by("id", F.struct("decided_at", "id")).alias("superseded_by"), F.max("decided_at").alias("valid_until"))
    out = decisions.join(later, "id", "left")
    status = F.when(F.col("superseded_by").isNotNull() & (F.col("status") == "accepted"), "superseded").otherwise(F.col("status"))
    return out.withColumn("status", status)


def as_of(decisions: DataFrame, day: Column | str, start: str = "decided_at", end: str = "valid_until") -> DataFrame:
    """Decisions valid on a day: from the day they are decided until the day before their end."""
    day = F.lit(day) if isinstance(day, str) else day
    return decisions.where((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) > day)))


def chained(rows: DataFrame, key: list[str], order: list[str], start: str) -> DataFrame:
    """rows with valid_until, the start of the next of their key: a chain of which each link supersedes the one before."""
    return rows.withColumn("valid_until", F.lead(start).over(Window.partitionBy(*key).orderBy(*order)))


def trace(decisions: DataFrame, id_: str) -> DataFrame:
    """id, step: the chain through a decision, back (negative steps) and forward, to its ends; ids met before end it, so cycles do too."""
    links = decisions.where("supersedes is not null").select("id", "supersedes").persist()
    spark, found = decisions.sparkSession, {id_: 0}
    for sign, source, target in ((-1, "id", "supersedes"), (1, "supersedes", "id")):
        at, step = [id_], 0
        while at:
            step += sign
            rows = links.where(F.col(source).isin(at)).select(target).distinct().collect()
            at = [r[0] for r in rows if r[0] not in found]
            found |= {x: step for x in at}
    links.unpersist()
    return spark.createDataFrame(sorted(found.items(), key=lambda x: (x[1], x[0])), "id string, step int")


def stale(claims: DataFrame, files: DataFrame, keep_vanished: bool = True) -> DataFrame:
    """claims (file, source_hash) with stale: whether the file's text is another now; keep_vanished: claims on files that are gone are stale, else left out."""
    now = files.select(F.col("path").alias("_path"), F.col("hash").alias("_now"))
    out = claims.join(now, F.col("file") == F.col("_path"), "left" if keep_vanished else "inner")
    changed = F.col("_now").isNull() | (F.col("source_hash").isNotNull() & (F.col("source_hash") != F.col("_now")))
    return out.withColumn("stale", changed).drop("_path", "_now")


def asserted_edges(assertions: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Seam rows that assertions (kind, file, line, topic, direction, table, mode, method, path, author) add, for files that exist."""
    known = assertions.join(files.select(F.col("path").alias("file"), "is_test"), "file")
    source = F.concat(F.lit("asserted:"), "author").alias("source")
    common = [F.col("file").alias("path"), F.col("line").cast("int").alias("line"), source, "is_test"]
    by = F.lit("assertion")
    route = F.col("path")
    from fathom.functions.paths import normalize_route

    http = [F.upper("method").alias("method"), route.alias("route"), normalize_route(route).alias("norm")]
    return {
        "msg_edges": known.where("kind = 'kafka'").select(*common, "topic", "direction", F.lit(True).alias("resolved"), by.alias("via"), F.lit("kafka").alias("system")),
        "db_access": known.where("kind = 'db'").select(*common, F.lower("table").alias("tbl"), F.lit("sql").alias("kind"), "mode", by.alias("detail")),
        "http_endpoints": known.where("kind = 'http_endpoint'").select(*common, *http, by.alias("detail")),
        "http_calls": known.where("kind = 'http_call'").select(*common, *http, by.alias("detail")),
    }


def work_plan(files: DataFrame, insights: DataFrame, hashes: DataFrame) -> DataFrame:
    """target, hash: what has no insight, or one made from other text. hashes: target, hash of all that should have one."""
    return hashes.join(insights.select("target", "hash"), ["target", "hash"], "left_anti")
