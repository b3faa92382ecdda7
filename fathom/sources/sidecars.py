"""Side channels: decision records, assertions, compiler indexes, feature checklists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECISION = "id string, title string, status string, decided_at string, supersedes string, summary string, path string"
ASSERTION = (
    "kind string, file string, line int, evidence string, confidence string, author string, source_hash string, asserted_at string, topic string, direction string, "
    "`table` string, mode string, method string, path string, gap string, key string, reason string"
)
INDEX = "metadata struct<project_root:string>, documents array<struct<relative_path:string, occurrences:array<struct<symbol:string, symbol_roles:int, range:array<int>>>, symbols:array<struct<symbol:string, documentation:array<string>>>>>"
_RECORD = r"(?i)(^|/)adr/.*\.md$|(^|/)adr-[^/]*\.md$"
_ID = r"(?i)\badr-?[a-z0-9]+(?:\.[a-z0-9]+)*"  # numbers, letters, or both, with dots


def decision_of(path: str, text: str) -> dict | None:
    """A decision record's fields; None if neither its name nor its title holds an id."""
    title = re.search(r"^#\s+(.*)$", text, re.M)
    named = re.search(_ID, path.rsplit("/", 1)[-1].removesuffix(".md")) or re.search(_ID, title.group(1) if title else "")
    if not named:
        return None

    def field(name: str, value: str) -> str | None:
        m = re.search(rf"(?im)^[\s*>-]*\**{name}\**\s*:\**\s*{value}", text)
        return m.group(1).strip() if m else None

    section = re.search(r"(?ims)^##\s*decision\s*$(.*?)(?=^##\s|\Z)", text)
    summary = section.group(1).strip() if section else "\n".join(text.splitlines()[1:5]).strip()
    older = field("supersedes", r"\[?(adr-?[a-z0-9]+(?:\.[a-z0-9]+)*)")
    heading = re.sub(r"(?i)^adr-?[a-z0-9]+(?:\.[a-z0-9]+)*\s*[:.,\-–—]*\s*", "", title.group(1)).strip() if title else named.group().upper()
    return {
        "id": named.group().upper(), "title": heading, "status": (field("status", r"\**\s*(\w+)") or "accepted").lower(), "decided_at": field("date", r"(\d{4}-\d{2}-\d{2})"),
        "supersedes": older.upper() if older else None, "summary": summary[:400], "path": path,
    }


def decisions(corpus: DataFrame) -> DataFrame:
    """Decision records of a corpus; without a date, the file's day if it is known."""
    read = corpus.where(F.rlike("path", F.lit(_RECORD)))
    day = F.date_format("mtime", "yyyy-MM-dd") if "mtime" in corpus.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DECISION.split(", ")]
        for batch in batches:
            rows = []
            for path, text, known in batch.itertuples(index=False):
                if d := decision_of(path, text or ""):
                    rows.append(d | {"decided_at": d["decided_at"] or known})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return read.select("path", "text", day.alias("day")).mapInPandas(run, DECISION)


def decision_links(found: DataFrame, corpus: DataFrame, topics: DataFrame, tables: DataFrame, modules: DataFrame) -> DataFrame:
    """id, kind, target: topics and modules that a record's text holds, and tables that it holds as a word. Records are few; targets are joined on a condition."""
    text = found.join(corpus.select("path", "text"), "path").select("id", "text")
    parts = [
        text.join(topics.select("target"), F.contains("text", F.col("target"))).select("id", F.lit("topic").alias("kind"), "target"),
        text.join(tables.select("target"), F.expr(r"text rlike concat('(?i)\\b\\Q', target, '\\E\\b')")).select("id", F.lit("table").alias("kind"), "target"),
        text.join(modules.select("target"), F.contains("text", F.col("target"))).select("id", F.lit("module").alias("kind"), "target"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def assertions(spark: SparkSession, path: str) -> DataFrame:
    """Assertions and dismissals of a JSON array; malformed files give none."""
    read = spark.read.schema(f"{ASSERTION}, _bad string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.where("_bad is null and kind is not null").drop("_bad")


def compiler_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Definitions (symbol, path, line, docs) and references (symbol, path, line) of a compiler's index in JSON; local symbols are left out."""
    docs = spark.read.schema(INDEX).option("multiLine", "true").json(path).select(F.explode("documents").alias("d"))
    seen = docs.select(F.col("d.relative_path").alias("path"), F.explode("d.occurrences").alias("o"))
    seen = seen.select(F.col("o.symbol").alias("symbol"), "path", (F.get("o.range", F.lit(0)) + 1).alias("line"), F.coalesce(F.col("o.symbol_roles"), F.lit(0)).bitwiseAND(1).alias("defines"))
    seen = seen.where(~F.startswith("symbol", F.lit("local ")) & (F.col("symbol") != ""))
    told = docs.select(F.explode("d.symbols").alias("s")).select(F.col("s.symbol").alias("symbol"), F.array_join("s.documentation", "\n").alias("docs"))
    told = told.groupBy("symbol").agg(F.max("docs").alias("docs"))
    return seen.where("defines = 1").drop("defines").distinct().join(told, "symbol", "left"), seen.where("defines = 0").drop("defines").distinct()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message on the wire: integers as they are, everything with a length as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind in (1, 2, 5):
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire kind {kind}")


def _first_of(packed: bytes | int) -> int:
    """The first of packed integers."""
    if isinstance(packed, int):
        return packed
    value = shift = 0
    for byte in packed:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            break
    return value


def index_rows(data: bytes) -> Iterator[tuple[str, str, str | None, int | None, int | None, str | None]]:
    """(row, symbol, path, line, defines, docs) of a compiler index: its occurrences and its symbols."""
    for number, document in _fields(data):
        if number != 2:  # documents
            continue
        parts = list(_fields(document))
        path = next((v.decode() for n, v in parts if n == 1), "")
        for n, body in parts:
            if n == 2:  # an occurrence: range, symbol, roles
                given = {}
                for k, v in _fields(body):
                    given.setdefault(k, v)
                symbol = given.get(2, b"").decode()
                if symbol and not symbol.startswith("local "):
                    yield "seen", symbol, path, _first_of(given.get(1, 0)) + 1, int(given.get(3, 0)) & 1, None
            elif n == 3:  # a symbol: name, documentation
                told = list(_fields(body))
                yield "told", next((v.decode() for k, v in told if k == 1), ""), None, None, None, "\n".join(v.decode() for k, v in told if k == 3)


def compiler_index_binary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same of indexes in their binary form."""
    names = ["row", "symbol", "path", "line", "defines", "docs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(list(index_rows(content)), columns=names, dtype=object)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row string, symbol string, path string, line int, defines int, docs string")
    seen = rows.where("row = 'seen'").select("symbol", "path", "line", "defines").distinct()
    told = rows.where("row = 'told'").groupBy("symbol").agg(F.max("docs").alias("docs"))
    return seen.where("defines = 1").drop("defines").join(told, "symbol", "left"), seen.where("defines = 0").drop("defines")


def reference_edges(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """src, dst, kind of references to another file's definition."""
    last = defs.groupBy("symbol").agg(F.max_by("path", F.struct("path", "line")).alias("dst"))
    return refs.join(last, "symbol").where("path <> dst").select(F.col("path").alias("src"), "dst", F.lit("ref").alias("kind")).distinct()


def progress(corpus: DataFrame) -> DataFrame:
    """feature, total, done, doing, blocked, percent, requirements, clarifications, verdict of docs/features/*/{tasks,spec,review}.md."""
    own = corpus.where(F.rlike("path", F.lit(r"(^|/)docs/features/[^/]+/(tasks|spec|review)\.md$")))
    feature, kind = F.regexp_extract("path", r"docs/features/([^/]+)/", 1), F.regexp_extract("path", r"([^/]+)\.md$", 1)

    def boxes(mark: str):
        return F.sum(F.when(kind == "tasks", F.regexp_count("text", F.lit(rf"(?m)^\s*[-*]\s*\[{mark}\]"))).otherwise(0))

    out = own.groupBy(feature.alias("feature")).agg(
        boxes("[ xX~!]").alias("total"), boxes("[xX]").alias("done"), boxes("~").alias("doing"), boxes("!").alias("blocked"),
        F.sum(F.when(kind == "spec", F.regexp_count("text", F.lit(r"\bFR-\d+"))).otherwise(0)).alias("requirements"),
        F.sum(F.when(kind == "spec", F.regexp_count("text", F.lit("NEEDS CLARIFICATION"))).otherwise(0)).alias("clarifications"),
        F.max(F.when(kind == "review", F.regexp_extract("text", r"(?is).*verdict\W+(\w+)", 1))).alias("verdict"),
    )
    return out.withColumn("percent", F.when(F.col("total") > 0, F.bround(F.col("done") * 100 / F.col("total"))).otherwise(0).cast("int"))
