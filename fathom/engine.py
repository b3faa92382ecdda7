"""The engine: a corpus turned into tables, and the questions that the tables answer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.config import Config
from fathom.functions import paths
from fathom.functions.text import like_folded, spoken, task_terms
from fathom.operators import graph, memory, search, seams
from fathom.operators.extract import run
from fathom.sources import corpus as corpora
from fathom.sources import sidecars

Extractor = Callable[[DataFrame], dict[str, DataFrame]]
INSIGHTS = "target string, kind string, hash string, summary string, model string, generated_at timestamp"
LINKED = "id string, kind string, target string"


@dataclass
class Engine:
    """tables: files, symbols, calls, imports, edges, chunks, test_cases, the seams, decisions, decision_links, assertions, insights, references.

    Everything is lazy until `stored` writes the tables; queries are the same before and after. `failures` tells which extractor failed on which file.
    """

    corpus: DataFrame
    config: Config = Config()
    assertions: DataFrame | None = None
    index: tuple[DataFrame, DataFrame] | None = None
    insights: DataFrame | None = None
    extractors: list[Extractor] = field(default_factory=list)
    passes: list[Callable[[Engine], dict[str, DataFrame]]] = field(default_factory=list)
    tools: dict[str, Callable[..., object]] = field(default_factory=dict)
    reports: dict[str, Callable[[Engine], str]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    facts: DataFrame | None = None  # extracted rows of all tables
    shared: DataFrame | None = None  # constants, entities and settings by file
    extracted: DataFrame | None = None  # path of the files that the last refresh read
    unwritten: bool = False  # whether native tables are extracted whenever they are read

    def __post_init__(self) -> None:
        if not self.tables:
            self.tables = self._built()

    # ---- building

    def _marked(self, files: DataFrame) -> DataFrame:
        return self.corpus.join(files.select("path", "is_test", "lang"), "path")

    def _built(self) -> dict[str, DataFrame]:
        files = corpora.files(self.corpus, self.config)
        if self.facts is None:
            marked = corpora.with_tests(self.corpus, self.config)
            self.shared = run.shared_rows(marked)
            self.facts = run.facts(marked)
            self.unwritten = True
            return self._derived(files, run.apart(marked, run.SCHEMAS) | {"failures": self.facts})
        return self._derived(files, self.facts)

    def _derived(self, files: DataFrame, found: DataFrame | Mapping[str, DataFrame], known: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """All tables, from files and facts (of all tables, or of each); known: native tables that needn't be made from them."""
        spark = self.corpus.sparkSession
        t = {"files": files} | run.tables_of(found, self.shared, self.config) | (known or {})
        for extra in self.extractors:  # plug-in rows join the native tables, columns checked by name
            for name, rows in extra(self._marked(files)).items():
                t[name] = t[name].unionByName(rows, allowMissingColumns=True) if name in t else rows
        if self.assertions is not None:
            for name, rows in memory.asserted_edges(self.assertions, files).items():
                t[name] = t[name].unionByName(rows, allowMissingColumns=True)
        t["assertions"] = self.assertions if self.assertions is not None else spark.createDataFrame([], sidecars.ASSERTION)
        t["edges"] = run.import_edges(t["imports"], files, self.config)
        if self.index:
            t["definitions"], t["references"] = self.index
            t["edges"] = t["edges"].unionByName(sidecars.reference_edges(*self.index)).distinct()
        else:
            none = spark.createDataFrame([], "symbol string, path string, line int, docs string")
            t["definitions"], t["references"] = none, none.drop("docs")
        t["chunks"] = search.chunks(self.corpus, self.config.chunk_lines)
        t["decisions"] = memory.superseded(sidecars.decisions(self.corpus))
        targets = [
            t["msg_edges"].select(F.col("topic").alias("target")), t["db_defs"].select(F.col("tbl").alias("target")).union(t["db_access"].select("tbl")), files.select(F.col("module").alias("target")),
        ]
        t["decision_links"] = sidecars.decision_links(t["decisions"], self.corpus, *[x.where("target is not null").distinct() for x in targets])
        t["insights"] = self.insights if self.insights is not None else spark.createDataFrame([], INSIGHTS)
        self.tables = t
        for extra in self.passes:
            t |= extra(self)
        return t

    def stored(self, folder: str, lazy: Iterable[str] = ()) -> Engine:
        """The same engine over tables written as Parquet: facts first, in one pass over the texts, then the tables whose rows stand on names of other files, then what derives from them,
        several tables at a time (on small corpora jobs are short and their starts would add up). lazy: tables that are not written, but made whenever they are read."""
        spark = self.corpus.sparkSession

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        with ThreadPoolExecutor(8) as pool:
            first = [pool.submit(written, df, name) for df, name in ((self.facts, "facts"), (self.shared, "shared"), (self.tables["files"], "files"))]
            facts, shared, files = [f.result() for f in first]
            out = replace(self, facts=facts, shared=shared, tables={"files": files}, unwritten=False)
            native = run.tables_of(facts, shared, self.config)
            opened = {n: pool.submit(written, native[n], f"native_{n}") for n in run.OPEN}
            out.tables = out._derived(files, facts, {n: f.result() for n, f in opened.items()})
            plain = {n for n in (*run.SCHEMAS, "failures") if not self.extractors and self.assertions is None and not (n in run.OPEN and self.passes)} | {"files", *lazy}
            rest = {n: pool.submit(written, df, n) for n, df in out.tables.items() if n not in plain}
            out.tables = out.tables | {n: f.result() for n, f in rest.items()}
        return out

    def register(self, name: str, tool: Callable[..., object]) -> None:
        self.tools[name] = tool

    def _t(self, name: str) -> DataFrame:
        return self.tables[name]

    # ---- structure

    def index_status(self) -> dict[str, int]:
        return {n: self._t(n).count() for n in ("files", "symbols", "edges")} | {"failed_files": self._t("failures").select("path").distinct().count()}

    def search_code(self, query: str, limit: int = 8) -> DataFrame:
        """path, start_line, snippet, in_symbol: the best chunks, with the symbol each begins in."""
        found = search.search(self._t("chunks"), query, limit)
        marks = self._t("symbols").groupBy("path", F.col("line").alias("mark")).agg(F.max_by("name", "seq").alias("in_symbol"))
        out = graph.nearest_before(found, marks, ["path"], "start_line", "mark", ["in_symbol"])
        return out.orderBy("rank", "path", "start_line").select("path", "start_line", "snippet", "in_symbol")

    def find_symbol(self, name: str, exact: bool = False) -> DataFrame:
        hit = F.col("name") == name if exact else like_folded(F.col("name"), f"%{name}%")
        told = F.contains("text", F.lit(name)) if exact else like_folded(F.col("text"), f"%{name}%")
        return self._naming(told | F.rlike("text", F.lit(run.GENERATES)))["symbols"].where(hit).orderBy("name", "path", "line").limit(30).select("name", "kind", "signature", "parent", "path", "line")

    def file_outline(self, path: str) -> dict:
        own = self._t("files").where(F.col("path") == path).select("path", "lang", "lines").collect()
        if not own:
            return {}
        symbols = self._t("symbols").where(F.col("path") == path).orderBy("line", "seq").select("name", "kind", "line", "signature", "parent")
        edges = self._t("edges")
        return own[0].asDict() | {
            "symbols": _rows(symbols), "imports": _list(edges.where(F.col("src") == path).select("dst")), "imported_by": _list(edges.where(F.col("dst") == path).select("src")),
        }

    def blast_radius(self, path: str, depth: int = 2) -> DataFrame:
        root = self.corpus.sparkSession.createDataFrame([(path,)], "path string")
        return graph.blast_radius(self._t("edges"), root, depth, self._t("files").where("is_test"))

    def dependencies(self, path: str) -> DataFrame:
        return graph.dependencies(self._t("edges"), path)

    def module_map(self, prefix: str = "") -> DataFrame:
        return graph.module_map(self._t("files"), prefix).orderBy("dir")

    def hotspots(self, limit: int = 10) -> DataFrame:
        return graph.hotspots(self._t("edges"), min(limit, 30))

    def find_callers(self, name: str, limit: int = 40) -> DataFrame:
        return self._calls(name).where(F.col("callee") == name).orderBy("path", "line").limit(min(limit, 100)).select("caller", "parent", "path", "line")

    def find_callees(self, name: str) -> DataFrame:
        return self._calls(name).where(F.col("caller") == name).select("callee", "line").distinct().orderBy("line", "callee").limit(60)

    def _naming(self, told: Column) -> dict[str, DataFrame]:
        """symbols and calls of the files whose text meets a condition, at least. Names stand in texts as they are (but for Python's, whose letters other than ASCII are normalised), so where tables are
        extracted whenever they are read, other files are looked through but not read into tokens."""
        if not self.unwritten or self.extractors or self.passes:
            return self.tables
        marked = corpora.with_tests(self.corpus, self.config)
        folded = (paths.extension(F.col("path")) == "py") & (F.length("text") < F.octet_length("text"))
        found = run.facts(marked.where(told | folded), only={"symbols", "calls"})
        return {n: run.table_of(found, n) for n in ("symbols", "calls")}

    def _calls(self, name: str | None = None) -> DataFrame:
        """Calls (from or to a name, at least) with the first symbol of the caller's name in its file; calls outside any symbol are none."""
        t = self.tables if name is None else self._naming(F.contains("text", F.lit(name)))
        first = graph.first_claim(t["symbols"], ["path", "name"], ["seq"]).select("path", F.col("name").alias("caller"), "parent")
        return t["calls"].join(first, ["path", "caller"])

    def find_references(self, name: str, limit: int = 40) -> DataFrame:
        defs = self._t("definitions").where(like_folded(F.col("symbol"), f"%{name}%")).orderBy("symbol", "path", "line").limit(5)
        refs = self._t("references").select("symbol", F.struct("path", "line").alias("ref"))
        joined = defs.join(refs, "symbol", "left").groupBy("symbol", "path", "line", "docs").agg(F.slice(F.array_sort(F.collect_list("ref")), 1, limit).alias("references"))
        return joined.select("symbol", F.struct("path", "line").alias("defined"), F.substring("docs", 1, 150).alias("doc"), F.size("references").alias("reference_count"), "references")

    def goto_definition(self, name: str) -> DataFrame:
        found = self._t("definitions").where(like_folded(F.col("symbol"), f"%{name}%"))
        return found.orderBy(F.length("symbol"), "symbol", "path").limit(10).select("symbol", "path", "line", "docs")

    # ---- seams

    def message_flow(self, topic: str = "") -> DataFrame:
        """Per topic; over the summary threshold without a topic only the sides' counts, warnings first."""
        edges = self._t("msg_edges")
        if not topic and edges.select("topic").distinct().count() > self.config.summary_threshold:
            return seams.warned_first(seams.topic_sides(edges), "orphan", [(F.col("producers") + F.col("consumers")).desc(), F.col("topic")], self.config.max_rows)
        found = seams.message_sites(edges.where(like_folded(F.col("topic"), f"%{topic}%")) if topic else edges)
        keys = self._t("msg_topics").groupBy("topic").agg(F.array_sort(F.collect_set("config_key")).alias("config_keys"))
        return seams.warned_first(found.join(keys, "topic", "left"), "warning", [F.col("topic")], self.config.max_rows)

    def db_map(self, table: str = "") -> DataFrame:
        sides = seams.table_sides(self._t("db_defs"), self._t("db_access"))
        sides = sides.where(like_folded(F.col("tbl"), f"%{table}%")) if table else sides
        return seams.warned_first(sides, "warning", [(F.col("reads") + F.col("writes")).desc(), F.col("tbl")], self.config.max_rows)

    def http_map(self, path: str = "") -> dict[str, DataFrame]:
        endpoints, calls = self._t("http_endpoints"), self._t("http_calls")
        own = endpoints.where(like_folded(F.col("norm"), f"%{path}%")) if path else endpoints
        return {"matched": seams.called(own, calls), "uncalled": seams.uncalled(own, calls), "unmatched": seams.unmatched(endpoints, calls)}

    def graph_gaps(self, limit: int | None = None) -> DataFrame:
        t = self._t
        found = seams.gaps(t("msg_edges"), t("msg_topics"), t("db_defs"), t("db_access"), t("http_endpoints"), t("http_calls"))
        dismissed = t("assertions").where("kind = 'dismissal'").select(F.col("gap").alias("category"), F.col("key").alias("subject"))
        found = found.join(dismissed, ["category", "subject"], "left_anti").orderBy("category", "subject", "path", "line")
        return found if limit is None else graph_limit(found, limit)

    # ---- memory

    def explain(self, target: str) -> DataFrame:
        found = self._t("insights").where((F.col("target") == target) | like_folded(F.col("target"), f"%{target}%"))
        return memory.stale(found.select("*", F.when(F.col("kind") == "file", F.col("target")).alias("file"), F.col("hash").alias("source_hash")), self._t("files")).withColumn("stale", F.col("stale") & (F.col("kind") == "file"))

    def decisions(self, query: str = "", target: str = "", status: str = "", as_of: str = "") -> DataFrame:
        found = self._t("decisions")
        if query:
            found = found.where(like_folded(F.concat_ws(" ", "id", "title", "summary"), f"%{query}%"))
        if target:
            found = found.join(self._t("decision_links").where(like_folded(F.col("target"), f"%{target}%")).select("id").distinct(), "id", "left_semi")
        if status:
            found = found.where(F.col("status") == status)
        if as_of:
            found = memory.as_of(found, as_of)
        governs = self._t("decision_links").groupBy("id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "target"))).alias("governs"))
        return found.join(governs, "id", "left").orderBy(F.col("decided_at").desc(), "id").limit(20)

    def decision_trace(self, id_: str) -> DataFrame:
        chain = memory.trace(self._t("decisions"), id_.upper())
        return chain.join(self._t("decisions"), "id").orderBy("step")

    # ---- composites

    def _resolved(self, target: str) -> str | None:
        if self._t("files").where(F.col("path") == target).count():
            return target
        parent, _, name = target.rpartition(".")
        found = self._t("symbols").where((F.col("name") == name) & (F.col("parent") == parent) if parent else F.col("name") == target)
        row = found.orderBy((F.col("kind") == "class").desc(), "path").limit(1).collect()
        row = row or self._t("files").where(like_folded(F.col("path"), f"%{target}%")).orderBy("path").limit(1).collect()
        return row[0]["path"] if row else None

    def context_pack(self, target: str) -> dict:
        """All that concerns a file, class or method."""
        path = self._resolved(target)
        if path is None:
            return {"target": target, "error": "not found"}
        at = lambda name: self._t(name).where(F.col("path") == path)
        names = [r["name"] for r in at("symbols").select("name").distinct().collect()]
        callers = self._calls().where(F.col("callee").isin(names) & (F.col("path") != path)).orderBy("path", "line").limit(15)
        topics, tables = _list(at("msg_edges").select("topic")), _list(at("db_access").select("tbl").union(at("db_defs").select("tbl")))
        users = self._t("edges").where(F.col("dst") == path).select(F.col("src").alias("path")).distinct()
        tests = users.join(self._t("files").where("is_test").select("path"), "path", "left_semi")
        told = self._t("test_cases").join(tests, "path", "left_semi").select(spoken(F.col("name")).alias("behavior")).distinct().orderBy("behavior").limit(5)
        module = path.split("/")[0]
        links = self._t("decision_links").where(F.col("target").isin([*topics, *tables, module]))
        governing = self._t("decisions").join(links.select("id").distinct(), "id", "left_semi").where("valid_until is null and status = 'accepted'")
        return {
            "target": target, "file": path, "module": module, "outline": _rows(at("symbols").orderBy("line", "seq").limit(25).select("name", "kind", "line")), "callers": _rows(callers),
            "blast_radius": {"direct_dependents": users.count(), "sample": _list(users.orderBy("path").limit(15))}, "messaging": topics, "database": tables,
            "http": {k: _rows(at(f"http_{n}").orderBy("line").limit(15).select("method", "norm", "line")) for k, n in (("defines", "endpoints"), ("calls", "calls"))},
            "governing_decisions": _rows(governing.select("id", "title", "status")), "cached_insight": _rows(self.explain(path).limit(1)),
            "tests": {"files": _list(tests.orderBy("path").limit(5)), "behaviors": _list(told)},
        }

    def plan_context(self, task: str) -> dict:
        """Where to begin with a task: the terms' best chunks and symbols score their files."""
        spark = self.corpus.sparkSession
        terms = spark.createDataFrame([(task,)], "t string").select(task_terms(F.col("t")).alias("terms")).first()["terms"]
        best = search.search_any(self._t("chunks"), terms, 40).orderBy("rank", "path", "start_line").collect()  # 40 rows at most
        scored = spark.createDataFrame([(r["path"], 40 - i, "text") for i, r in enumerate(best)], "path string, points int, matched string")
        for term in terms[:6]:
            named = self._t("symbols").where(like_folded(F.col("name"), f"%{term}%")).orderBy(F.length("name"), "name", "path").limit(4)
            scored = scored.unionByName(named.select("path", F.lit(25).alias("points"), F.lit(term).alias("matched")))
        top = scored.groupBy("path").agg(F.sum("points").alias("points"), F.array_sort(F.collect_set("matched")).alias("matched")).orderBy(F.col("points").desc(), "path").limit(8)
        files = [r.asDict() for r in top.collect()]
        paths = [f["path"] for f in files]
        seam = lambda name, column: _list(self._t(name).where(F.col("path").isin(paths)).select(column))
        return {"task_terms": terms, "files_to_read": files, "messaging": seam("msg_edges", "topic"), "database": seam("db_access", "tbl"), "http": seam("http_endpoints", "norm"), "tests": seam("test_cases", "name")}

    def change_check(self, paths: list[str]) -> dict:
        """What an edit of up to 20 files touches, each reached file once."""
        spark = self.corpus.sparkSession
        asked = spark.createDataFrame([(p,) for p in paths[:20]], "path string").distinct()
        known = asked.join(self._t("files").select("path"), "path", "left_semi")
        reached = graph.blast_radius(self._t("edges"), known, 2, self._t("files").where("is_test"), repeats=False)
        here = self._t("msg_edges").join(known, "path", "left_semi")
        # a side of a topic is touched as a whole if all its production files are among the checked
        files = seams.production(self._t("msg_edges")).join(here.select("topic").distinct(), "topic", "left_semi").select("topic", "direction", "path").distinct()
        files = files.join(known.select("path", F.lit(True).alias("_known")), "path", "left")
        sole = files.groupBy("topic", "direction").agg(F.count_if(F.col("_known").isNull()).alias("others")).where("others = 0 and direction in ('produce', 'consume')")
        at = lambda df: df.join(known, "path", "left_semi")
        users = _rows(self._t("edges").join(known, F.col("dst") == known["path"], "left_semi").groupBy("dst").agg(F.count("*").alias("n")))
        dependents = {r["dst"]: r["n"] for r in users}
        seam = lambda name, *columns: _rows(at(self._t(name)).select("path", F.concat_ws(" ", *columns).alias("s")).distinct().orderBy("path", "s"))
        touched = {"messaging": seam("msg_edges", "direction", "topic"), "database": seam("db_access", "mode", "tbl"), "endpoints": seam("http_endpoints", "method", "norm")}
        names = _list(here.select("topic").union(at(self._t("db_access")).select("tbl")).union(known.select(F.split_part("path", F.lit("/"), F.lit(1)))))
        links = self._t("decision_links").where(F.col("target").isin(names))
        governing = self._t("decisions").join(links.select("id").distinct(), "id", "left_semi").where("valid_until is null and status = 'accepted'")
        risk = self._t("assertions").join(known, F.col("file") == known["path"], "left_semi").where("kind <> 'dismissal'")
        return {
            "files": {"checked": _list(known), "not_in_index": _list(asked.join(known, "path", "left_anti"))},
            "blast_radius": _list(reached.where("not is_test").select("path")), "tests_to_rerun": _list(reached.where("is_test").select("path")),
            "seam_warnings": {
                "unresolved_expressions": _list(here.where("not resolved").select("topic")), "sole_seam_side": _list(sole.select("topic")),
                "drift_tables_touched": _list(at(seams.drift_sites(self._t("db_defs"), self._t("db_access"))).select("tbl")),
                "endpoints_with_no_caller": _list(at(seams.uncalled(self._t("http_endpoints"), self._t("http_calls"))).select("norm")),
            },
            "per_file": [{"path": p, "direct_dependents": dependents.get(p, 0)} | {k: [r["s"] for r in v if r["path"] == p] for k, v in touched.items()} for p in _list(known)],
            "governing_decisions": _rows(governing.select("id", "title", "status").orderBy("id")),
            "assertions_at_risk": _rows(risk.select("kind", "file", "line")),
        }

    # ---- refresh

    def refreshed(self, corpus: DataFrame) -> Engine:
        """An engine over a later snapshot, equal to a rebuild: only files that changed, and files that name a constant, entity or setting that did, are extracted again.

        Where so many changed that a build is cheaper, everything is.
        """
        from fathom.streaming import refresh

        t, listed = self._t("files"), corpora.files(corpus, self.config)
        refresh.guarded(t.count(), corpus.limit(1).count())
        diff = refresh.snapshot_diff(t, listed).persist()
        again = replace(self, corpus=corpus, tables={"files": listed}, facts=None, shared=None, extracted=corpus.select("path"), unwritten=False)
        if refresh.is_wide(diff.count(), t.count()):
            again.tables = again._built()
            return again
        marked = corpora.with_tests(corpus, self.config)
        touched = diff.where("change <> 'removed'").select("path")
        again.shared = refresh.overwritten(self.shared, run.shared_rows(marked.join(F.broadcast(touched), "path", "left_semi")), diff).persist()
        changed = refresh.changed_keys(run.names_of(self.shared, self.config), run.names_of(again.shared, self.config), "wanted")
        named = changed.select(F.expr("substring(wanted, instr(wanted, ':') + 1)")).distinct().limit(refresh.MOST_KEYS + 1).collect()  # with more, all files are read
        keys = sorted(r[0] for r in named)
        again.extracted = touched.union(refresh.widened(corpus, keys)).distinct().persist() if keys else touched
        gone = diff.select("path").union(again.extracted).distinct()
        again.facts = refresh.overwritten(self.facts, run.facts(marked.join(F.broadcast(again.extracted), "path", "left_semi")), gone)
        again.tables = again._derived(listed, again.facts)
        return again


def graph_limit(df: DataFrame, limit: int) -> DataFrame:
    """The first rows of each category."""
    from pyspark.sql import Window

    w = Window.partitionBy("category").orderBy("subject", "path", "line")
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _list(df: DataFrame) -> list:
    return sorted({r[0] for r in df.collect()} - {None})


def budgeted(document: dict | list, most_bytes: int) -> str:
    """JSON of at most so many bytes, longest lists halved until it fits."""
    from copy import deepcopy

    document = deepcopy(document)

    def lists(x) -> list[list]:
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        return ([x] if isinstance(x, list) else []) + [y for v in inner for y in lists(v)]

    while len(text := json.dumps(document, default=str)) > most_bytes and (long := max(lists(document), key=len, default=[])) and len(long) > 1:
        del long[len(long) // 2 :]
    return text
