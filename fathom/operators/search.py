"""Full-text search over line chunks, ranked by BM25 over trigrams' substring counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import occurrences

CHUNK_LINES, K1, B = 40, 1.2, 0.75


def chunks(corpus: DataFrame, lines: int = CHUNK_LINES) -> DataFrame:
    """path, start_line, content: windows of whole lines; blank ones are dropped. Built per row, without a shuffle."""
    parts = F.split(F.col("text"), "\n")
    cut = F.transform(
        F.sequence(F.lit(0), ((F.size("_lines") - 1) / lines).cast("int")),
        lambda i: F.struct((i * lines + 1).alias("start_line"), F.array_join(F.slice("_lines", i * lines + 1, F.lit(lines)), "\n").alias("content")),
    )
    out = corpus.select("path", parts.alias("_lines")).select("path", F.inline(cut))
    return out.where(F.length(F.regexp_replace("content", r"\s+", "")) > 0)


def _trigrams() -> Column:
    return F.greatest(F.length("path") - 2, F.lit(0)) + F.greatest(F.length("content") - 2, F.lit(0))


def scored(found: DataFrame, phrases: list[str]) -> DataFrame:
    """found with f (occurrences of each phrase in path and content) and ranks (BM25 of each, 0 where it has none, else the more negative the better).

    However many phrases, chunks are counted in one pass and their statistics (rows, mean length, rows with each phrase) are one aggregate, joined as a single row.
    """
    each = F.array(*[occurrences(F.col("path"), p) + occurrences(F.col("content"), p) for p in phrases])
    counted = found.withColumns({"f": each, "_d": _trigrams()})
    hits = F.array(*[F.count_if(F.get("f", F.lit(i)) > 0) for i in range(len(phrases))])
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_d").alias("_avg"), hits.alias("_hits"))

    def rank(f: Column, h: Column) -> Column:
        idf = F.greatest(F.ln((F.col("_n") - h + 0.5) / (h + 0.5)), F.lit(1e-6))
        return F.when(f > 0, -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_d") / F.col("_avg")))).otherwise(F.lit(0.0))

    some = counted.where(F.exists("f", lambda x: x > 0)).join(F.broadcast(stats))
    return some.withColumn("ranks", F.zip_with("f", "_hits", rank)).drop("_d", "_n", "_avg", "_hits")


def ranked(found: DataFrame, phrase: str) -> DataFrame:
    """found with f (occurrences of the phrase in path and content) and rank (BM25, the more negative the better); chunks without it are gone."""
    return scored(found, [phrase]).withColumns({"f": F.get("f", F.lit(0)), "rank": F.get("ranks", F.lit(0))}).drop("ranks")


def search(found: DataFrame, phrase: str, limit: int = 8) -> DataFrame:
    """path, start_line, f, rank, snippet: the best chunks for a phrase of at least three characters."""
    if len(phrase) < 3:
        return ranked(found.limit(0), "...").select("path", "start_line", "f", "rank", F.lit("").alias("snippet"))
    at = F.instr(F.lower("content"), F.lit(phrase.lower()))
    shown = F.concat(
        F.substring(F.col("content"), F.greatest(at - 40, F.lit(1)), F.least(at - 1, F.lit(40))), F.lit(">>>"), F.substring(F.col("content"), at, F.lit(len(phrase))),
        F.lit("<<<"), F.substring(F.col("content"), at + len(phrase), F.lit(60)),
    )
    out = ranked(found, phrase).withColumn("snippet", F.when(at > 0, shown).otherwise(F.col("path")))
    return out.orderBy("rank", "path", "start_line").limit(min(limit, 25)).select("path", "start_line", "f", "rank", "snippet")


def search_any(found: DataFrame, phrases: list[str], limit: int = 40) -> DataFrame:
    """path, start_line, rank: chunks that hold any phrase, by the sum of the phrases' ranks."""
    known = [p for p in dict.fromkeys(phrases) if len(p) >= 3]
    if not known:
        return found.limit(0).select("path", "start_line", F.lit(0.0).alias("rank"))
    total = scored(found, known).select("path", "start_line", F.aggregate("ranks", F.lit(0.0), lambda a, r: a + r).alias("rank"))
    return total.groupBy("path", "start_line").agg(F.sum("rank").alias("rank")).orderBy("rank", "path", "start_line").limit(limit)
