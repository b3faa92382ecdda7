"""Published documents: a JSON snapshot of the graph, Markdown reports, and prompts. All read small aggregates of an engine's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import graph, memory, seams
from fathom.sources import sidecars

SITES, TEST_SITES, MODULES = 12, 6, 30


def _rows(df: DataFrame, most: int) -> tuple[list[dict], int]:
    """The first rows, and how many more there are."""
    rows = [r.asDict(recursive=True) for r in df.limit(most).collect()]
    return rows, (df.count() - most if len(rows) == most else 0)


def export(engine) -> dict:
    """The graph as one document: modules, topics, tables, endpoints, gaps, annotations. Entries with warnings are never dropped."""
    t, most = engine.tables, 4 * engine.config.max_doc_items
    deps = graph.module_edges(t["edges"]).groupBy(F.col("src_module").alias("dir")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("dst_module").alias("id")))).alias("d"))
    modules = graph.module_map(t["files"]).join(deps, "dir", "left").orderBy(F.col("files").desc(), "dir")
    sides = seams.warned_first(seams.message_sites(t["msg_edges"]), "warning", [F.col("topic")], most, keep_warned=True)
    sides = sides.select("topic", F.slice("producers", 1, SITES).alias("producers"), F.slice("consumers", 1, SITES).alias("consumers"), F.slice("test_usage", 1, TEST_SITES).alias("tests"), "warning")
    tables = seams.warned_first(seams.table_sides(t["db_defs"], t["db_access"]), "warning", [F.col("tbl")], most, keep_warned=True)
    uncalled = seams.uncalled(t["http_endpoints"], t["http_calls"]).select("path", "line", "method", "norm").withColumn("warning", F.lit("no caller"))
    ends = t["http_endpoints"].join(uncalled, ["path", "line", "method", "norm"], "left")
    ends = seams.warned_first(ends.select("method", "norm", "path", "line", "detail", "is_test", "warning"), "warning", [F.col("norm"), F.col("method"), F.col("path")], most, keep_warned=True)
    claims = memory.stale(t["assertions"].where("kind <> 'dismissal'").select("kind", "file", "line", "author", "source_hash"), t["files"])
    out = {"schema": 1, "modules": [], "annotations": {"assertions": _rows(claims, most)[0], "insights": _rows(t["insights"].select("target", "kind", "summary"), most)[0]}}
    for m in _rows(modules, MODULES)[0]:
        out["modules"].append({"id": m["dir"], "files": m["files"], "langs": m["langs"].split(","), "deps": [d["id"] for d in m["d"] or []]})
    for name, df in (("topics", sides), ("tables", tables), ("endpoints", ends), ("gaps", engine.graph_gaps())):
        out[name] = [r.asDict(recursive=True) for r in df.collect()]
    return out


def export_json(engine, pretty: bool = False) -> str:
    return json.dumps(export(engine), indent=2 if pretty else None, default=str, ensure_ascii=False)


def _table(title: str, columns: list[str], rows: list[dict], more: int = 0) -> str:
    cell = lambda v: ", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(cell(r.get(c)).replace("|", "\\|").replace("\n", " ") for c in columns) + " |" for r in rows]
    return "\n".join(lines + ([f"", f"…and {more} more"] if more > 0 else [])) + "\n"


def reports(engine) -> dict[str, str]:
    """File names and Markdown texts; plug-in reports follow, and one that fails is left out."""
    t, most = engine.tables, engine.config.max_doc_items
    plans = {
        "architecture.md": ("Architecture", ["dir", "files", "langs"], engine.module_map()),
        "module-dependencies.md": ("Dependencies between modules", ["src_module", "dst_module", "n"], graph.module_edges(t["edges"]).orderBy(F.col("n").desc(), "src_module", "dst_module")),
        "hotspots.md": ("Most depended on", ["path", "dependents"], graph.hotspots(t["edges"], 10)),
        "message-flows.md": ("Message flows", ["topic", "producers", "consumers", "test_usage", "warning"], seams.message_sites(t["msg_edges"]).orderBy("topic")),
        "data-map.md": ("Data", ["tbl", "ops", "reads", "writes", "tests", "warning"], seams.table_sides(t["db_defs"], t["db_access"]).orderBy("tbl")),
        "http-map.md": ("HTTP", ["method", "norm", "path", "line", "detail"], t["http_endpoints"].orderBy("norm", "method", "path", "line")),
        "decisions.md": ("Decisions", ["id", "title", "status", "decided_at", "valid_until", "superseded_by"], t["decisions"].orderBy("id")),
        "progress.md": ("Progress", ["feature", "total", "done", "doing", "blocked", "percent", "requirements", "clarifications", "verdict"], sidecars.progress(engine.corpus).orderBy("feature")),
        "insights.md": ("Insights", ["target", "kind", "summary"], t["insights"].orderBy("target")),
        "gaps.md": ("Gaps", ["category", "subject", "path", "line"], engine.graph_gaps()),
    }
    out = {}
    for name, (title, columns, df) in plans.items():
        rows, more = _rows(df, most)
        out[name] = _table(title, columns, rows, more)
    out["architecture.md"] += f"\n```mermaid\n{diagram(engine)}\n```\n"
    out["agent-context.md"] = agent_context(engine)
    for name, report in engine.reports.items():
        try:
            out[name] = report(engine)
        except Exception:
            continue
    return out


MIGRATIONS = [("prisma:%", "Prisma"), ("rails:%", "Rails"), ("alembic:%", "Alembic"), ("V%\\_\\_%", "Flyway"), ("%:%", "Liquibase")]


def migration_tools(engine) -> DataFrame:
    """tool, tables: by the tags of schema definitions."""
    tool = F.lit("plain SQL")
    for pattern, name in reversed(MIGRATIONS):
        tool = F.when(F.col("changeset").like(pattern), name).otherwise(tool)
    return engine.tables["db_defs"].select("tbl", F.when(F.col("changeset").isNull(), "plain SQL").otherwise(tool).alias("tool")).groupBy("tool").agg(F.countDistinct("tbl").alias("tables"))


def diagram(engine) -> str:
    """The heaviest edges between modules, as a Mermaid graph."""
    from fathom.functions.text import slug

    edges = graph.module_edges(engine.tables["edges"]).orderBy(F.col("n").desc(), "src_module", "dst_module").limit(engine.config.max_diagram_nodes)
    safe = [F.regexp_replace(slug(F.col(c)), "-", "_").alias(c) for c in ("src_module", "dst_module")]
    return "\n".join(["graph LR", *[f"  {r.src_module} -->|{r.n}| {r.dst_module}" for r in edges.select(*safe, "n").collect()]])


def agent_context(engine) -> str:
    """A short orientation: size, modules, hotspots, the seams' counts, migration tools, open gaps."""
    t = engine.tables
    status = engine.index_status()
    gaps = engine.graph_gaps().groupBy("category").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("subject")), 1, 3).alias("some")).orderBy("category").collect()
    lines = [f"{status['files']} files, {status['symbols']} symbols, {status['edges']} edges", ""]
    lines += [f"- {r.dir}: {r.files} files ({r.langs})" for r in engine.module_map().orderBy(F.col("files").desc(), "dir").limit(15).collect()]
    lines += [f"- used by {r.dependents}: {r.path}" for r in engine.hotspots(5).collect()]
    lines += [f"- {n}: {t[n].count()}" for n in ("msg_edges", "db_defs", "db_access", "http_endpoints", "http_calls", "test_cases")]
    lines += [f"- schema by {r.tool}: {r.tables} tables" for r in migration_tools(engine).orderBy("tool").collect()]
    lines += [f"- {g.category}: {g.n} ({', '.join(g.some)}{', …' if g.n > len(g.some) else ''})" for g in gaps]
    return "\n".join(lines) + "\n"


def resources(engine) -> dict:
    """Named read-only documents; `context` and `decision` take what they are about."""
    claims = memory.stale(engine.tables["assertions"].where("kind <> 'dismissal'"), engine.tables["files"])
    as_json = lambda df: json.dumps([r.asDict(recursive=True) for r in df.collect()], default=str)
    return {
        "graph": lambda: export_json(engine), "status": lambda: json.dumps(engine.index_status()), "context": lambda target: json.dumps(engine.context_pack(target), default=str),
        "decisions": lambda: as_json(engine.tables["decisions"].orderBy("id")), "decision": lambda id_: as_json(engine.tables["decisions"].where(F.col("id") == id_.upper())), "assertions": lambda: as_json(claims),
    }


def work(engine, hotspots: int = 12) -> DataFrame:
    """target, kind, hash: modules and the most used files that have no insight made from their present text."""
    t = engine.tables
    modules = graph.module_hash(t["files"]).select(F.col("module").alias("target"), F.lit("module").alias("kind"), "hash")
    top = graph.hotspots(t["edges"], hotspots).join(t["files"], "path").select(F.col("path").alias("target"), F.lit("file").alias("kind"), "hash")
    return memory.work_plan(t["files"], t["insights"], modules.unionByName(top))


def prompt(engine, kind: str, target: str = "") -> str:
    """Texts from live queries: impact (of a file), orient, resolve-gap, release-check."""
    if kind == "impact":
        found = engine.change_check([target])
        return f"Changing {target} reaches {len(found['blast_radius'])} files and {len(found['tests_to_rerun'])} test files.\n" + json.dumps(found, indent=1, default=str)
    if kind == "orient":
        return "\n".join(reports(engine)[n] for n in ("architecture.md", "hotspots.md", "gaps.md"))
    gaps = [r.asDict() for r in engine.graph_gaps().limit(1 if kind == "resolve-gap" else engine.config.max_rows).collect()]
    if kind == "resolve-gap":
        return "No gap is open." if not gaps else f"Open gap: {gaps[0]['category']}: {gaps[0]['subject']} at {gaps[0]['path']}:{gaps[0]['line']}"
    if kind == "release-check":
        return f"{len(gaps)} open gaps\n" + "\n".join(f"- {g['category']}: {g['subject']} ({g['path']}:{g['line']})" for g in gaps)
    raise ValueError(f"no prompt {kind!r}")
