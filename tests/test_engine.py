import json
import os

import pytest
from pyspark.sql import functions as F

from fathom.engine import Engine, budgeted
from fathom.functions import paths
from fathom.operators import annotate, graph, memory, plugins, publish, seams, search
from fathom.operators.extract import run
from fathom.sources import corpus, sidecars
from fathom.streaming import refresh

FILES = {
    "order-service/src/main/java/OrderController.java": '@RestController\n@RequestMapping("/api")\npublic class OrderController {\n  @GetMapping("/orders/{id}") public String one(String id) { return find(id); }\n  @GetMapping("/never") public String never() { return ""; }\n}\n',
    "order-service/src/main/java/Publisher.java": 'public class Publisher {\n  static final String CREATED = "orders.created";\n  void go() { kafkaTemplate.send(CREATED, x); kafkaTemplate.send(CREATED + "." + env, x); }\n}\n',
    "order-service/src/main/java/Payment.java": '@Table(name = "payments")\n@Entity\npublic class Payment {}\n',
    "order-service/src/main/resources/application.yml": "app:\n  refund-topic: refunds.requested\n  in-topic: orders.created\n",
    "order-service/db/changelog/one.xml": '<databaseChangeLog><changeSet id="1" author="alice"><createTable tableName="payments"/></changeSet></databaseChangeLog>',
    "billing-service/src/main/java/Listener.java": 'import order.x.Publisher;\npublic class Listener {\n  @KafkaListener(topics = "${app.in-topic}")\n  void on(String s) { jdbcTemplate.query("SELECT * FROM legacy_invoices", m); }\n}\n',
    "billing-service/src/test/java/ListenerTest.java": 'public class ListenerTest {\n  static final String CREATED = "test.topic";\n  @Test void listensToOrders() { kafkaTemplate.send("only.tests", x); }\n}\n',
    "web-app/src/client.ts": "import { y } from './util';\nexport class Client {\n  load(id) { return fetch(`${BASE}/api/orders/${id}`); }\n}\nfetch('/api/nothing');\n",
    "web-app/src/util.ts": "import { z } from './deep';\nexport const y = (a) => { return z(a); };\n",
    "web-app/src/deep.ts": "export function z(a) { return a; }\n",
    "web-app/src/client.spec.ts": "import { Client } from './client';\nit('loads an order', () => { new Client().load(1); });\n",
    "docs/adr/ADR-007-queues.md": "# ADR-007: Use queues\n\nStatus: accepted\nDate: 2026-01-01\n\n## Decision\nEvents go to orders.created and payments.\n",
    "docs/adr/ADR-012-log.md": "# ADR-012: Use a log\n\nDate: 2026-06-01\nSupersedes: ADR-007\n\n## Decision\nOne log.\n",
    "docs/features/cart/tasks.md": "- [x] one\n- [X] two\n- [~] three\n- [ ] four\n- [!] five\n",
    "docs/features/cart/spec.md": "FR-1 and FR-2\nNEEDS CLARIFICATION: who\n",
}


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    for path, text in FILES.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_text(text)
    os.makedirs(root / "web-app/node_modules/x")
    (root / "web-app/node_modules/x/skipped.js").write_text("function no() {}")
    (root / "web-app/src/big.ts").write_text("x" * 1_600_000)
    (root / "web-app/readme.unknown").write_text("no")
    return root


@pytest.fixture(scope="module")
def engine(spark, workspace, tmp_path_factory):
    return Engine(corpus.load(spark, [str(workspace)])).stored(str(tmp_path_factory.mktemp("tables")))


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_sources(spark, workspace, engine):
    assert rows(engine.tables["files"], "path") == {(p,) for p in FILES}
    assert rows(engine.tables["files"].where("is_test"), "path") == {("billing-service/src/test/java/ListenerTest.java",), ("web-app/src/client.spec.ts",)}
    assert corpus.discovered(str(workspace)) == [str(workspace)]
    both = corpus.load(spark, [str(workspace / "docs"), str(workspace / "web-app")])
    assert ("web-app/src/util.ts",) in rows(both, "path") and engine.index_status()["files"] == len(FILES)


def test_messages(engine):
    flow = {r.topic: r for r in engine.message_flow().collect()}
    created = flow["orders.created"]
    assert created.warning is None and "Publisher.java:3" in created.producers[0] and "Listener.java:3" in created.consumers[0] and created.config_keys == ["app.in-topic"]
    assert flow["orders.created.{?}"].unresolved_expressions and flow["only.tests"].warning == "only tests use it"
    assert rows(seams.unused_declarations(engine.tables["msg_topics"], engine.tables["msg_edges"]), "topic") == {("refunds.requested",)}


def test_tables_and_routes(engine):
    assert {r.tbl: r.warning for r in engine.db_map().collect()} == {"payments": None, "legacy_invoices": "accessed but not defined"}
    http = engine.http_map()
    assert rows(http["matched"], "e_norm", "c_path") == {("/api/orders/{}", "web-app/src/client.ts")}
    assert rows(http["uncalled"], "norm") == {("/api/never",)} and rows(http["unmatched"], "norm") == {("/api/nothing",)}


def test_graph(engine):
    assert ("web-app/src/client.ts", "web-app/src/util.ts") in rows(engine.tables["edges"], "src", "dst")
    assert rows(engine.dependencies("web-app/src/util.ts"), "dst") == {("web-app/src/deep.ts",)}
    reached = engine.blast_radius("web-app/src/deep.ts", 5)
    assert rows(reached, "path", "depth", "is_test") == {("web-app/src/util.ts", 1, False), ("web-app/src/client.ts", 2, False), ("web-app/src/client.spec.ts", 3, True)}
    assert engine.hotspots(1).count() == 1 and ("web-app",) in rows(engine.module_map(), "dir") and rows(engine.module_map("web-app"), "dir") == {("src",)}
    assert rows(engine.find_callers("z"), "caller", "path") == {("y", "web-app/src/util.ts")} and rows(engine.find_callees("one"), "callee") == {("find",)}
    assert rows(engine.find_symbol("ORDERC"), "name") == {("OrderController",)} and engine.find_symbol("orderc", exact=True).count() == 0
    assert engine.file_outline("web-app/src/util.ts")["imported_by"] == ["web-app/src/client.ts"] and engine.file_outline("no") == {}


def test_blast_radius_levels(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "path string")
    assert rows(graph.blast_radius(edges, root, 3), "path", "depth") == {("b", 1), ("c", 1), ("d", 2), ("a", 3)}
    assert rows(graph.blast_radius(edges, root, 3, repeats=False), "path", "depth") == {("b", 1), ("c", 1), ("d", 2)}


def test_search(engine):
    found = engine.search_code("kafkaTemplate").collect()
    assert {r.path.split("/")[-1] for r in found} == {"Publisher.java", "ListenerTest.java"} and all(">>>kafkaTemplate<<<" in r.snippet for r in found)
    assert {r.in_symbol for r in found} == {"Publisher", "ListenerTest"}


def test_gaps_and_dismissals(spark, engine):
    gaps = rows(engine.graph_gaps(), "category", "subject")
    assert {("tables_accessed_but_undefined", "legacy_invoices"), ("endpoints_with_no_caller", "GET /api/never"), ("topics_declared_in_config_but_unused", "refunds.requested"), ("unresolved_topic_expressions", "orders.created.{?}")} <= gaps
    dismissed = [("dismissal", None, "tables_accessed_but_undefined", "legacy_invoices")]
    t = engine.tables | {"assertions": spark.createDataFrame(dismissed, "kind string, file string, gap string, key string")}
    assert ("tables_accessed_but_undefined", "legacy_invoices") not in rows(Engine(engine.corpus, tables=t).graph_gaps(), "category", "subject")
    assert engine.graph_gaps(1).groupBy("category").count().agg(F.max("count")).first()[0] == 1


def test_decisions(engine):
    d = {r.id: r for r in engine.decisions().collect()}
    assert (d["ADR-007"].status, d["ADR-007"].valid_until, d["ADR-007"].superseded_by) == ("superseded", "2026-06-01", "ADR-012")
    assert d["ADR-007"].governs == ["table:payments", "topic:orders.created"]
    assert rows(engine.decisions(as_of="2026-05-31"), "id") == {("ADR-007",)} and rows(engine.decisions(as_of="2026-06-01"), "id") == {("ADR-012",)}
    assert [(r.id, r.step) for r in engine.decision_trace("adr-012").collect()] == [("ADR-007", -1), ("ADR-012", 0)]
    assert engine.decisions(target="payments").count() == 1 and engine.decisions(status="accepted").count() == 1


def test_relative_imports_are_resolved_step_by_step(spark):
    files = corpus.files(spark.createDataFrame([(p, "x") for p in ("a/b/m.ts", "a/c/n.ts", "a/src/foo.ts", "z/foo.ts", "src/a/foo.ts")], "path string, text string"))
    named = [("a/b/m.ts", "./x/../../c/n"), ("a/b/m.ts", "../../../../c/n"), ("a/b/m.ts", ".././c/n.ts"), ("a/c/n.ts", "src/a/foo"), ("a/c/n.ts", "@/src/foo")]
    edges = run.import_edges(spark.createDataFrame(named, "path string, module string"), files)
    assert rows(edges, "src", "dst") == {("a/b/m.ts", "a/c/n.ts"), ("a/c/n.ts", "src/a/foo.ts"), ("a/c/n.ts", "a/src/foo.ts")}


def test_decision_ids(spark):
    named = {"docs/adr/deep/er/ADR-007-x.md": "ADR-007", "ADR-A.2_note.md": "ADR-A.2", "docs/adr/n.md": "ADR-PAY.1"}
    got = sidecars.decisions(spark.createDataFrame([(p, f"# {i}: T\n\nSupersedes: ADR-B1\n") for p, i in named.items()], "path string, text string"))
    assert rows(got, "path", "id", "title", "supersedes") == {(p, i, "T", "ADR-B1") for p, i in named.items()}


def test_routes_join_equals_the_wildcard_test_on_all_pairs(spark):
    import itertools

    words = ["a", "b", "{}"]
    ends = ["/" + "/".join(x) for n in range(4) for x in itertools.product(words, repeat=n)]
    called = [*ends, *["/" + "/".join([*x, "{**}"]) for n in range(3) for x in itertools.product(words, repeat=n)]]
    e = spark.createDataFrame([(m, x, i) for m in ("GET", "PUT") for i, x in enumerate(ends)], "method string, norm string, k int")
    c = spark.createDataFrame([("GET", x, i) for i, x in enumerate(called)], "method string, norm string, k int")
    want = e.join(c.toDF("m2", "n2", "k2"), (F.col("method") == F.col("m2")) & paths.routes_match(F.col("norm"), F.col("n2"))).select("k", "k2")
    got = seams.called(e, c).select(F.col("e_k").alias("k"), F.col("c_k").alias("k2"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 500


def test_blast_radius_plan_grows_with_depth_and_search_not_with_terms(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    edges = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(9)], "src string, dst string")
    root = spark.createDataFrame([("n0",)], "path string")
    assert graph.blast_radius(edges, root, 5).count() == 5 and plan(graph.blast_radius(edges, root, 5)) == 0
    chunks = spark.createDataFrame([("a", 1, "one two three")], "path string, start_line int, content string")
    assert plan(search.search_any(chunks, ["one"])) == plan(search.search_any(chunks, ["one", "two", "three"])) == 1


def test_sites_shown_are_bounded(spark):
    edges = spark.createDataFrame([("t", f"p{i:04}", i, "produce", True, None, "kafka", "static", False) for i in range(300)], "topic string, path string, line int, direction string, resolved boolean, via string, system string, source string, is_test boolean")
    [r] = seams.message_sites(edges, 5).collect()
    assert r.n_producers == 300 and r.producers == [f"p{i:04}:{i} [kafka]" for i in range(5)] and r.warning == "produced but never consumed"


def test_trace_ends_in_a_cycle(spark):
    loop = spark.createDataFrame([("A", "B"), ("B", "A")], "id string, supersedes string")
    assert memory.trace(loop, "A").count() == 2


def test_trace_follows_a_chain_to_both_ends(spark):
    chain = spark.createDataFrame([(f"{i:02}", f"{i - 1:02}" if i else None) for i in range(58)], "id string, supersedes string").coalesce(1)
    assert {(r.id, r.step) for r in memory.trace(chain, "54").collect()} == {(f"{i:02}", i - 54) for i in range(58)}


def test_composites(engine):
    pack = engine.context_pack("Client")
    assert pack["file"] == "web-app/src/client.ts" and pack["tests"] == {"files": ["web-app/src/client.spec.ts"], "behaviors": ["loads an order"]}
    assert engine.context_pack("Nothing.at.all")["error"] == "not found"
    plan = engine.plan_context("fix the kafkaTemplate publisher")
    assert plan["task_terms"] == ["fix", "kafkatemplate", "publisher"] and plan["files_to_read"][0]["path"].endswith("Publisher.java") and "orders.created" in plan["messaging"]
    check = engine.change_check(["web-app/src/util.ts", "billing-service/src/main/java/Listener.java", "gone.py"])
    assert check["files"]["not_in_index"] == ["gone.py"] and check["tests_to_rerun"] == ["web-app/src/client.spec.ts"]
    assert check["seam_warnings"]["drift_tables_touched"] == ["legacy_invoices"] and check["seam_warnings"]["sole_seam_side"] == ["orders.created"]
    assert len(budgeted({"a": list(range(1000))}, 500)) <= 500


def test_change_check_counts_files_and_names_decisions(spark, engine):
    producer, listener = "orders/src/A.java", "billing/src/B.java"
    held = lambda n, rows: spark.createDataFrame(rows, engine._t(n).schema)
    like = lambda n, **values: tuple(values.get(f.name) for f in engine._t(n).schema)
    empty = {n: held(n, []) for n in ("edges", "assertions", "db_defs", "db_access", "http_endpoints", "http_calls")}
    sent = [like("msg_edges", path=p, line=k, topic="t", direction="produce", resolved=True, is_test=False) for p, k in ((producer, 1), (producer, 2), (listener, 1))]
    tables = empty | {
        "files": held("files", [like("files", path=p, is_test=False) for p in (producer, listener)]), "msg_edges": held("msg_edges", sent),
        "decisions": held("decisions", [like("decisions", id="D-1", title="x", status="accepted")]), "decision_links": held("decision_links", [like("decision_links", id="D-1", kind="topic", target="t")]),
    }
    over = Engine(engine.corpus, tables=tables)
    assert over.change_check([producer])["seam_warnings"]["sole_seam_side"] == []
    both = over.change_check([producer, listener])
    assert both["seam_warnings"]["sole_seam_side"] == ["t"] and [g["id"] for g in both["governing_decisions"]] == ["D-1"]
    assert [(f["path"], f["messaging"]) for f in both["per_file"]] == [(listener, ["produce t"]), (producer, ["produce t"])]


def test_publishing(engine):
    out = json.loads(publish.export_json(engine))
    assert out["schema"] == 1 and {m["id"] for m in out["modules"]} >= {"web-app", "docs"} and any(t["warning"] for t in out["tables"])
    found = publish.reports(engine)
    assert "| cart | 5 | 2 | 1 | 1 | 40 | 2 | 1 |" in found["progress.md"] and "legacy_invoices" in found["data-map.md"]
    assert publish.work(engine, 2).where("kind = 'file'").count() == 2 and "ADR-012" in found["decisions.md"]
    assert "1 test files" in publish.prompt(engine, "impact", "web-app/src/deep.ts") or "client.ts" in publish.prompt(engine, "impact", "web-app/src/deep.ts")
    assert publish.prompt(engine, "release-check").split()[0].isdigit()


def test_write_back(spark, engine, tmp_path):
    path = str(tmp_path / "docs" / "assertions.json")
    hashes = {r.path: r.hash for r in engine.tables["files"].collect()}
    row = {"kind": "kafka", "file": "web-app/src/util.ts", "line": 1, "evidence": "seen in the running service", "topic": "orders.created", "direction": "consume", "author": "ann"}
    annotate.assert_edge(path, row, hashes)
    assert len(annotate.assert_edge(path, row | {"evidence": "seen again in the service"}, hashes)) == 1
    for bad in ({"kind": "x"}, {"direction": "sideways"}, {"file": "gone"}, {"evidence": ""}, {"evidence": "seen"}):
        with pytest.raises(ValueError):
            annotate.assert_edge(path, row | bad, hashes)
    annotate.dismiss(path, "gap", "key", "fine", "ann")
    claims = sidecars.assertions(spark, path)
    assert claims.count() == 2
    edges = memory.asserted_edges(claims, engine.tables["files"])["msg_edges"]
    assert rows(edges, "topic", "source", "via") == {("orders.created", "asserted:ann", "assertion")}
    later = engine.tables["files"].withColumn("hash", F.when(F.col("path") == row["file"], "new").otherwise(F.col("hash")))
    kafka = claims.where("kind = 'kafka'")
    assert rows(memory.stale(kafka, engine.tables["files"]), "stale") == {(False,)} and rows(memory.stale(kafka, later), "stale") == {(True,)}
    gone = engine.tables["files"].where(F.col("path") != row["file"])
    assert rows(memory.stale(kafka, gone), "stale") == {(True,)} and memory.stale(kafka, gone, keep_vanished=False).count() == 0
    assert annotate.reaffirm(path, row, hashes | {row["file"]: "new"})[0]["source_hash"] == "new" and len(annotate.retract(path, row)) == 1
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        annotate.dismiss(str(tmp_path / "bad.json"), "a", "b", "c", "d")
    assert sidecars.assertions(spark, str(tmp_path / "bad.json")).count() == 0
    first = annotate.save_decision(str(tmp_path / "adr"), "Use it", "we do", day="2026-02-03")
    assert first.endswith("ADR-001-use-it.md") and annotate.save_decision(str(tmp_path / "adr"), "B", "c", supersedes="ADR-001").endswith("ADR-002-b.md")
    assert sidecars.decision_of(first, open(first).read())["decided_at"] == "2026-02-03"
    with pytest.raises(ValueError):
        annotate.insight("a", "module", "short", "h")
    assert annotate.insight("a", "module", "x" * 5000, "h")["summary"] == "x" * 4000


def test_compiler_index(spark, tmp_path):
    index = {"documents": [{"relative_path": "a.ts", "occurrences": [{"symbol": "pkg f().", "symbol_roles": 1, "range": [4, 0, 3]}, {"symbol": "local 1", "symbol_roles": 1, "range": [0]}], "symbols": [{"symbol": "pkg f().", "documentation": ["does f"]}]}, {"relative_path": "b.ts", "occurrences": [{"symbol": "pkg f().", "symbol_roles": 0, "range": [9, 1, 2]}], "symbols": []}]}
    (tmp_path / "i.json").write_text(json.dumps(index))
    defs, refs = sidecars.compiler_index(spark, str(tmp_path / "i.json"))
    assert rows(defs, "symbol", "path", "line", "docs") == {("pkg f().", "a.ts", 5, "does f")} and rows(sidecars.reference_edges(defs, refs), "src", "dst", "kind") == {("b.ts", "a.ts", "ref")}
    files = spark.createDataFrame([("a.ts", "x"), ("b.ts", "y")], "path string, text string")
    engine = Engine(files, index=(defs, refs))
    assert engine.find_references("f()").first().reference_count == 1 and engine.goto_definition("F()").first().path == "a.ts"


def test_binary_compiler_index(spark, tmp_path):
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(number, value):
        return varint(number * 8) + varint(value) if isinstance(value, int) else varint(number * 8 + 2) + varint(len(value)) + value

    f = b"pkg f()."
    a = field(1, b"a.ts") + field(2, field(1, varint(300) + varint(0) + varint(3)) + field(2, f) + field(3, 9)) + field(3, field(1, f) + field(3, b"does f")) + field(2, field(1, bytes([1, 0, 1])) + field(2, b"local 3") + field(3, 1))
    b = field(1, b"b.ts") + field(2, field(1, bytes([9, 1, 2])) + field(2, f))
    (tmp_path / "index.scip").write_bytes(field(1, field(3, b"file:///x")) + field(2, a) + field(2, b))
    defs, refs = sidecars.compiler_index_binary(spark, str(tmp_path / "index.scip"))
    assert rows(defs, "symbol", "path", "line", "docs") == {("pkg f().", "a.ts", 301, "does f")} and rows(refs, "symbol", "path", "line") == {("pkg f().", "b.ts", 10)}


def test_resources_and_context(engine):
    assert set(publish.resources(engine)) == {"graph", "status", "context", "decisions", "decision", "assertions"}
    assert "ADR-012" in publish.resources(engine)["decision"]("ADR-012") and "refunds.requested" in publish.agent_context(engine)
    assert "web_app" in publish.diagram(engine) or "graph LR" in publish.diagram(engine)


def test_refresh_equals_rebuild(spark, engine):
    old = engine.corpus.select("path", "text")
    new = old.withColumn("text", F.when(F.col("path").endswith("Publisher.java"), F.replace("text", F.lit("orders.created"), F.lit("orders.made"))).otherwise(F.col("text"))).where("path not like '%util.ts'")
    diff = refresh.snapshot_diff(engine.tables["files"], corpus.files(new))
    assert rows(diff, "path", "change") == {("order-service/src/main/java/Publisher.java", "changed"), ("web-app/src/util.ts", "removed")}
    again = engine.refreshed(new)
    assert "orders.made" in {r.topic for r in again.tables["msg_edges"].collect()} and ("web-app/src/util.ts",) not in rows(again.tables["files"], "path")
    assert rows(again.extracted, "path") == {("order-service/src/main/java/Publisher.java",), ("billing-service/src/test/java/ListenerTest.java",)}  # the changed file, and one that names CREATED
    rebuilt = Engine(new.select("path", "text"))
    for name in (*run.SCHEMAS, "edges", "decision_links"):
        assert sorted(map(str, again.tables[name].collect())) == sorted(map(str, rebuilt.tables[name].collect())), name
    kept = refresh.overwritten(engine.tables["msg_edges"], again.tables["msg_edges"].join(diff, "path", "left_semi"), diff)
    assert rows(kept, "path", "topic", "line") == rows(again.tables["msg_edges"], "path", "topic", "line")
    assert rows(refresh.widened(old, ["CREATED"]), "path") == {("order-service/src/main/java/Publisher.java",), ("billing-service/src/test/java/ListenerTest.java",)}
    assert refresh.widened(old, [str(i) for i in range(51)]).count() == len(FILES) and refresh.is_wide(60, 100) and not refresh.is_wide(50, 60)
    with pytest.raises(ValueError):
        engine.refreshed(new.limit(0))


def test_failures_are_told(spark):
    files = spark.createDataFrame([("a/A.java", "class A { void m() {} }"), ("a/b.yml", "x: y")], "path string, text string")
    found = run.facts(corpus.with_tests(files), {}, {}, None)  # settings that can't be read
    assert run.table_of(found, "symbols").count() == 2 and run.table_of(found, "failures").count() == 0
    listening = files.withColumn("text", F.lit('class A { @KafkaListener(topics = "${k}") void m() {} }'))
    [failure] = run.table_of(run.facts(corpus.with_tests(listening.where("path like '%java'")), {}, {}, None), "failures").collect()
    assert failure.path == "a/A.java" and failure.message.startswith("msg_edges: AttributeError")


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "path string, text string").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in"))
    refresh.continuous(stream, lambda df, n: got.extend(df.collect()), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(r.path for r in got) == ["a", "b"]


def test_plugins(spark, tmp_path):
    (tmp_path / "one.py").write_text("def rows(path, text):\n    return [{'topic': 'bus', 'direction': 'produce', 'line': 1, 'resolved': True, 'system': 'bus'}]\n")
    assert plugins.trusted(str(tmp_path)) == [] and list(plugins.approve(str(tmp_path))) == ["one.py"]
    [path] = plugins.trusted(str(tmp_path))
    rows_ = plugins.loaded(path).rows
    namespace = {}
    exec(open(path).read(), namespace)
    del rows_
    files = spark.createDataFrame([("A.java", "class A {}")], "path string, text string")
    engine = Engine(files, extractors=[plugins.extractor(namespace["rows"], "msg_edges")])
    assert rows(engine.tables["msg_edges"], "topic", "source") == {("bus", "plugin")}
    engine.register("count", lambda: engine.index_status()["files"])
    assert engine.tools["count"]() == 1
    (tmp_path / "one.py").write_text("tampered = 1")
    assert plugins.trusted(str(tmp_path)) == []


def test_names_are_looked_up_however_many_there_are(spark):
    keys = "".join(f"k{i}: topic.{i}\n" for i in range(200_002))
    java = 'class A {\n  static final String Q = "DELETE FROM old_rows";\n  @KafkaListener(topics = "${k200001}") void m() {}\n  void n() { kafkaTemplate.send("a." + B.T, x); jdbcTemplate.update(Q); }\n}\n'
    files = [("s/application.yml", keys), ("s/A.java", java), ("s/B.java", 'class B { static final String T = "t"; }'), ("t/B.java", 'class B { static final String T = "u"; }')]
    t = Engine(spark.createDataFrame(files, "path string, text string")).tables
    assert rows(t["msg_edges"], "path", "topic", "direction", "line", "resolved", "via") == {("s/A.java", "topic.200001", "consume", 3, True, "k200001"), ("s/A.java", "a.t", "produce", 4, True, None)}
    assert rows(t["db_access"], "tbl", "mode", "detail", "source") == {("old_rows", "write", "JdbcTemplate.update", "static")}


def test_joined_names_give_the_rows_that_maps_give(spark):
    from fathom.config import Config

    repository = "interface R extends JpaRepository<Payment, Long> {}\ninterface O extends JpaRepository<Order, Long> {}\n"
    more = {
        "a/src/R.java": repository + 'class Z { @Query("select x from Payment x join Order o") void q(); void s() { jdbcTemplate.query(Publisher.CREATED, m); kafkaTemplate.send(List.of(CREATED, "x"), y); } }',
        "a/src/test/java/OwnTest.java": 'class OwnTest { static final String CREATED = "own"; void s() { kafkaTemplate.send(CREATED, x); kafkaTemplate.send(OTHER, x); } }',
        "a/src/Plain.java": 'class Plain { void s() { kafkaTemplate.send("b", x); kafkaTemplate.send("b", x); jdbcTemplate.query("SELECT 1 FROM t", m); } }',
        "a/q.py": 'import boto3\nsqs.send_message(QueueUrl="https://q/jobs")\ncur.execute("SELECT a FROM b")\n',
    }
    marked = corpus.with_tests(spark.createDataFrame([*FILES.items(), *more.items()], "path string, text string"))
    config = Config(table_name_overrides={"Order": "Orders_2"})
    shared = run.shared_rows(marked)
    maps = {k: {} for k in ("constants", "entities", "settings")}
    for r in run.names_of(shared, config).collect():
        tag, _, key = r.wanted.partition(":")
        maps[tag][key] = r.value
    assert maps["entities"] == {"Payment": "payments", "Order": "orders_2"} and maps["constants"] == {"CREATED": "orders.created"}
    closed, got = run.facts(marked, *maps.values()), run.tables_of(run.facts(marked), shared, config)
    assert ("own",) in rows(got["msg_edges"], "topic") and ("orders_2",) in rows(got["db_access"], "tbl")
    for name in run.SCHEMAS:
        assert sorted(map(str, got[name].collect())) == sorted(map(str, run.table_of(closed, name).collect())), name
    assert got["failures"].count() == 0


def test_a_pass_for_one_table_reads_only_files_that_may_hold_it(spark):
    unread = F.when(F.startswith("path", F.lit("web-app/")) | F.endswith("path", F.lit(".java")), F.raise_error(F.concat(F.lit("read "), "path"))).otherwise(F.col("text"))
    marked = corpus.with_tests(spark.createDataFrame(list(FILES.items()), "path string, text string").withColumn("text", unread))
    found = run.table_of(run.facts(marked, only={"db_defs"}), "db_defs")
    assert rows(found, "tbl") == {("payments",)}


def test_imports_are_found_without_reading_tokens():
    from fathom.operators.extract.source import Source

    src = Source("a/A.java", "import b.B;\nclass A { void m() { go(); } }")
    [found] = [extract(src) for tables, _, extract in run._extractors(None) if "imports" in tables]
    assert found == {"imports": [{"module": "b.B"}]} and "_read" not in vars(src)


def test_blast_radius_of_code_extracts_imports_once(spark, sf_dir, monkeypatch):
    from fathom.plans import tools

    kept = []
    monkeypatch.setattr(tools, "written", lambda df, label: kept.append(label) or df)
    assert tools.import_blast_radius(spark, sf_dir).count() and kept == ["edges"]


NAMED = [
    ("a/A.java", "@Data\npublic class Box {\n  private int weight;\n  void lift() { heave(1); }\n}\n"), ("a/B.java", "public class Cart { void push() { heave(2); lift(); } }\n"),
    ("a/c.py", "def ﬁnd(x):\n    return heave(x)\ndef other():\n    return ﬁnd(1)\n"), ("a/D.java", "public class Door { void open() { knock(); } }\n"),
]


def test_names_are_looked_for_in_texts_before_tokens(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame(NAMED, "path string, text string")
    lazy, stored = Engine(files), Engine(files).stored(str(tmp_path / "tables"))
    asked = [lambda e: e.find_callers("heave"), lambda e: e.find_callers("find"), lambda e: e.find_callees("find"), lambda e: e.find_callees("push"), lambda e: e.find_symbol("GETWEI"), lambda e: e.find_symbol("find", exact=True), lambda e: e.find_symbol("b_x")]
    found = [ask(lazy).collect() for ask in asked]
    assert found == [ask(stored).collect() for ask in asked] and all(found)
    read = []
    facts = run.facts
    monkeypatch.setattr(run, "facts", lambda corpus, *a, **k: (read.append(corpus), facts(corpus, *a, **k))[1])
    lazy.find_callers("knock")
    assert rows(read[0], "path") == {("a/D.java",), ("a/c.py",)}


def test_stored_tables_are_made_once_and_may_stay_lazy(spark, workspace, tmp_path):
    engine = Engine(corpus.load(spark, [str(workspace)]))
    stored = engine.stored(str(tmp_path / "tables"), lazy=["chunks"])
    assert not os.path.exists(tmp_path / "tables/chunks")
    links = stored._derived(stored.tables["files"], stored.facts, {n: stored.tables[n] for n in run.OPEN})["decision_links"]
    assert "MapInArrow" not in links._jdf.queryExecution().toString()  # topics and tables of links are read, not made again
    for n in ("chunks", "msg_edges", "db_access", "decision_links"):
        assert sorted(map(str, stored.tables[n].collect())) == sorted(map(str, engine.tables[n].collect()))
