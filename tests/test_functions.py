import gc
import re
import weakref

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.functions import paths, text
from fathom.operators import search
from fathom.operators.extract import data, http, messaging, symbols
from fathom.operators.extract.source import Source


def column(spark, values, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(expression(F.col("v"))).collect()]


def test_routes_are_normalized_alike_in_both_places(spark):
    raw = ["https://h.io/api//a/?q=1", "/u/:id/", "x/${base}/{n}#f", "/", "", "HTTP://a.b", "/a/b///"]
    assert column(spark, raw, paths.normalize_route) == [http.normalized(r) for r in raw] == ["/api/a", "/u/{}", "/x/{}/{}", "/", "/", "/", "/a/b"]


@settings(max_examples=60, deadline=None)
@given(st.text("a/:?#.", max_size=15))
def test_normalizing_twice_changes_nothing(raw):
    once = http.normalized(raw)
    assert http.normalized(once) == once and once.startswith("/")


@pytest.mark.parametrize(
    "endpoint,call,fits",
    [("/a/{}", "/a/7", True), ("/a/{}", "/a", False), ("/a/b", "/{}/a/b", True), ("/a/b", "/a/{**}", True), ("/", "/{**}", True), ("/", "/", True), ("/a", "/", False), ("/a/b/c", "/{}/b/{**}", True), ("/x/y", "/a/{**}", False), ("/a/b", "/{}/c/b", False)],
)
def test_routes_match(spark, endpoint, call, fits):
    df = spark.createDataFrame([(endpoint, call)], "e string, c string")
    assert df.select(paths.routes_match(F.col("e"), F.col("c"))).first()[0] is fits


def test_test_paths_and_languages(spark):
    given_ = ["a/src/main/java/FooTest.java", "a/src/test/java/X.java", "a/tests/x.py", "x/FooIT.java", "x/a.spec.ts", "x/test_a.py", "x/contest.py", "x/conftest.py", "x/Foo.java", "x/a.test.mts", "x/a.spec.cjs", "x/a.test.mjs", "x/FooTest.scala"]
    assert column(spark, given_, paths.is_test) == [False, True, True, True, True, True, False, True, False, True, True, True, False]
    assert column(spark, ["a/B.PY", "b.kt", "c", "d.prisma", "e.zig"], paths.language) == ["python", "kotlin", "other", "config", "other"]


def test_text_functions(spark):
    assert column(spark, ["OrderLine2Item", "already_snake"], text.snake) == ["order_line2_item", "already_snake"]
    assert column(spark, ["rejectsEmpty_cart", "says it"], text.spoken) == ["rejects empty cart", "says it"]
    assert column(spark, ["a\nb\n", "", "x"], text.line_count) == [3, 1, 1]
    assert column(spark, ["Add the OrderService retry, retry to order.created topics"], text.task_terms) == [["orderservice", "retry", "order.created", "topics"]]
    assert column(spark, ["select * from a.B join c on 1=1", "UPDATE t set x=1"], text.sql_tables) == [["b", "c"], ["t"]]
    assert column(spark, ["FindById", "finÉ"], lambda c: text.like_folded(c, "%FINDB_%")) == [True, False]


def naive_rank(rows, phrase):
    import math

    n = len(rows)
    f = [sum(len(re.findall(f"(?={re.escape(phrase)})", x.lower())) for x in r) for r in rows]
    d = [sum(max(len(x) - 2, 0) for x in r) for r in rows]
    hits, mean = sum(x > 0 for x in f), sum(d) / n
    idf = max(math.log((n - hits + 0.5) / (hits + 0.5)), 1e-6)
    return {r: -idf * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * b / mean)) for r, a, b in zip(rows, f, d) if a}


def test_search_equals_a_naive_scorer(spark):
    rows = [("a/aaa.py", "aaaa bbb"), ("b.py", "bbb ccc aaa"), ("c.py", "nothing here at all"), ("d.py", "AAA")]
    df = spark.createDataFrame([(p, 1, c) for p, c in rows], "path string, start_line int, content string")
    got = {(r.path, r.content): r["rank"] for r in search.ranked(df, "aaa").collect()}
    assert got == pytest.approx(naive_rank(rows, "aaa"))
    assert search.search(df, "aaa").first().snippet.count(">>>") in (0, 1) and search.search(df, "aa").count() == 0
    assert {r.path for r in search.search_any(df, ["aaa", "ccc"]).collect()} == {"a/aaa.py", "b.py", "d.py"}


def test_chunks(spark):
    df = spark.createDataFrame([("a", "\n".join(map(str, range(90)))), ("b", "\n" * 50 + "x"), ("c", "")], "path string, text string")
    assert sorted((r.path, r.start_line, r.content.count("\n")) for r in search.chunks(df).collect()) == [("a", 1, 39), ("a", 41, 39), ("a", 81, 9), ("b", 41, 10)]


def src(path, body, is_test=False):
    return Source(path, body, is_test)


def test_topic_expressions():
    names, conf = {"ORDERS": "orders.v1"}, {"app.topic": "conf.topic"}
    for expression, want in [
        ('"a.b"', [("a.b", True, None)]), ("Topics.ORDERS", [("orders.v1", True, "ORDERS")]), ('"${app.topic}"', [("conf.topic", True, "app.topic")]), ('"${no.such:dflt}"', [("dflt", True, "no.such")]),
        ('"${no.such}"', [("${no.such}", False, "no.such")]), ('ORDERS + "." + env', [("orders.v1.{?}", False, "runtime concatenation")]), ('"a" + ORDERS', [("aorders.v1", True, None)]), ('{"x", "y"}', [("x", True, None), ("y", True, None)]), ("topic", [("topic", False, None)]),
    ]:
        assert messaging.resolve(expression, conf, names) == want, expression


def test_config_files():
    yaml = "spring:\n  kafka:\n    topic: orders  # note\n    empty:\n  list:\n    - x\napp:\n  'queue-name': \"q1\"\n"
    assert messaging.config(src("a/application.yml", yaml)) == [("spring.kafka.topic", "orders"), ("app.queue-name", "q1")]
    assert messaging.config(src("a/application.properties", "a.b = c\n# x=y\nd: e f\n")) == [("a.b", "c"), ("d", "e f")]
    assert messaging.declared(src("a/application.yml", yaml), messaging.config(src("a/application.yml", yaml)))[0] == {"topic": "orders", "config_key": "spring.kafka.topic", "line": 3}


def test_jvm_messages():
    body = """class A {
  @KafkaListener(topics = {"one", Names.TWO}, groupId = "g")
  void on(String s) { template.send("three", s); }
  @JmsListener(destination = "jq") void j() {}
  void p() { rabbitTemplate.convertAndSend("rq", x); new ProducerRecord<String, String>(Names.TWO, v); flux.subscribe(y); kafkaConsumer.subscribe(List.of("four")); }
}"""
    got = {(e["topic"], e["direction"], e["system"], e["line"]) for e in messaging.jvm_edges(src("A.java", body), {}, {"TWO": "two"})}
    assert got == {("one", "consume", "kafka", 2), ("three", "produce", "kafka", 3), ("jq", "consume", "jms", 4), ("rq", "produce", "rabbit", 5), ("two", "produce", "kafka", 5), ("four", "consume", "kafka", 5)}


def test_broker_clients():
    js = "const amqp = require('amqplib')\nch.sendToQueue('jobs', b)\nch.consume(`jobs`, f)\nbus.publish('other')"
    assert {(e["topic"], e["direction"]) for e in messaging.broker_edges(src("a.js", js))} == {("jobs", "produce"), ("jobs", "consume")}
    py = "import boto3\nsqs.send_message(QueueUrl='https://sqs/1/mail', MessageBody=b)"
    assert messaging.broker_edges(src("a.py", py))[0]["topic"] == "mail"


def test_schema_definitions():
    xml = '<databaseChangeLog>\n<changeSet id="001" author="alice">\n<createTable tableName="Orders"/></changeSet>\n<changeSet author="bob" id="2"><renameTable oldTableName="a" newTableName="b"/></changeSet></databaseChangeLog>'
    assert {(d["tbl"], d["op"], d["changeset"], d["line"]) for d in data.changelog(src("db/changelog/x.xml", xml))} == {("orders", "create", "alice:001", 3), ("a", "drop", "bob:2", 4), ("b", "create", "bob:2", 4)}
    flyway = src("db/migration/V2__add.sql", "CREATE TABLE IF NOT EXISTS app.sessions (id int);\nalter table users add x int;")
    assert data.is_changelog(flyway) and [(d["tbl"], d["op"], d["changeset"]) for d in data.changelog(flyway)] == [("sessions", "create", "V2__add"), ("users", "alter", "V2__add")]
    yml = "databaseChangeLog:\n- changeSet:\n    id: 7\n    author: eve\n    changes:\n    - createTable:\n        tableName: carts\n"
    assert [(d["tbl"], d["op"], d["changeset"]) for d in data.changelog(src("changelog.yml", yml))] == [("carts", "create", "eve:7")]
    prisma = 'model Cart {\n id Int\n @@map("cart_items")\n}\nmodel User { id Int }'
    assert [(d["tbl"], d["changeset"]) for d in data.schema_definitions(src("p/schema.prisma", prisma))] == [("cart_items", "prisma:Cart"), ("user", "prisma:User")]
    assert data.schema_definitions(src("db/migrate/1_x.rb", "create_table :carts do"))[0] == {"tbl": "carts", "op": "create", "line": 1, "changeset": "rails:1_x"}
    assert data.schema_definitions(src("migrations/a.py", "revision = 'r1'\nop.add_column('audit', c)"))[0] == {"tbl": "audit", "op": "alter", "line": 2, "changeset": "alembic:r1"}


def test_data_access():
    java = """import com.querydsl.jpa.impl.JPAQueryFactory;
@Table(name = "payments")
@Entity
public class Payment {}
@Entity class OrderLine {}
interface PayRepo extends JpaRepository<Payment, Long> { @Query("update Payment p set p.x = 1") void u(); @Query(value = "select * from legacy", nativeQuery = true) List l(); }
class D { void a() { jdbcTemplate.query("SELECT * FROM app.users JOIN roles ON 1=1", m); jdbcTemplate.update(SQL); f.update(QPayment.payment); } }"""
    s = src("A.java", java)
    assert {k: v for k, v, _ in data.entities(s)} == {"Payment": "payments", "OrderLine": "order_line"}
    got = {(a["tbl"], a["kind"], a["mode"]) for a in data.jvm_access(s, {"Payment": "payments"}, {"SQL": "DELETE FROM old_rows"})}
    assert got == {("payments", "entity", "rw"), ("order_line", "entity", "rw"), ("payments", "repository", "rw"), ("payments", "sql", "write"), ("legacy", "sql", "read"), ("users", "sql", "read"), ("roles", "sql", "read"), ("old_rows", "sql", "write")}
    py = "class A(Base):\n    __tablename__ = 'audit'\ncur.execute(\"insert into log values (1)\")\nlog.query('no table')"
    assert {(a["tbl"], a["mode"]) for a in data.generic_access(src("a.py", py))} == {("audit", "rw"), ("log", "write")}


def test_http():
    java = '@RestController\n@RequestMapping("/api")\npublic class C {\n @GetMapping("/orders/{id}") String a() {}\n @RequestMapping(value = "/x", method = RequestMethod.POST) String b() {}\n @DeleteMapping void c() {}\n void d() { restTemplate.getForObject("http://h/api/y", X.class); w.post().uri("/z/{a}"); }\n}'
    endpoints, calls = http.jvm(src("C.java", java))
    assert {(e["method"], e["norm"]) for e in endpoints} == {("GET", "/api/orders/{}"), ("POST", "/api/x"), ("DELETE", "/api")}
    assert {(c["method"], c["norm"]) for c in calls} == {("GET", "/api/y"), ("POST", "/z/{}")}
    feign = http.jvm(src("F.java", '@FeignClient(name = "users")\ninterface F { @GetMapping("/u/{id}") U u(); }'))
    assert feign[0] == [] and feign[1][0]["detail"] == "FeignClient(users)"
    ts = "app.get('/api/cart', h); emitter.app.get('event');\nfetch(`${BASE}/api/orders/${id}`, { method: 'PUT' });\naxios.post('/api/x/' + id)"
    endpoints, calls = http.web(src("a.ts", ts))
    assert [(e["method"], e["norm"]) for e in endpoints] == [("GET", "/api/cart")]
    assert {(c["method"], c["norm"]) for c in calls} == {("PUT", "/{}/api/orders/{}"), ("POST", "/api/x/{**}")}
    assert http.web(src("b.ts", "fetch('data:x'); fetch(''); axios.get('mailto:a@b'); fetch('/ok')"))[1][0]["norm"] == "/ok"
    assert len(http.web(src("b.ts", "fetch('data:x'); fetch(''); axios.get('mailto:a@b'); fetch('/ok') // fetch('/no')"))[1]) == 1
    nest = http.web(src("n.ts", "@Controller('v2')\nclass C { @Get('items/:id') a() {} @Post() b() {} }"))[0]
    assert {(e["method"], e["norm"]) for e in nest} == {("GET", "/v2/items/{}"), ("POST", "/v2")}
    endpoints, calls = http.python(src("a.py", "@app.route('/h/<int:x>', methods=['GET', 'POST'])\n@api.get('/f/{y}')\nrequests.get(f'/api/{z}')\nsession.get('mailto:a@b')"))
    assert {(e["method"], e["norm"]) for e in endpoints} == {("GET", "/h/{}"), ("POST", "/h/{}"), ("GET", "/f/{}")} and [c["norm"] for c in calls] == ["/api/{}"]


def test_symbols_and_calls():
    py = "class A:\n    def m(self, x=1):\n        helper(x)\n        print(x)\n        self.m()\ndef helper(y):\n    return y\nhelper(2)\n"
    found, calls = symbols.extract(src("a.py", py), "python")
    assert [(s["name"], s["kind"], s["parent"], s["line"]) for s in found] == [("A", "class", None, 1), ("m", "method", "A", 2), ("helper", "function", None, 6)]
    assert calls == [{"caller": "m", "callee": "helper", "line": 3}]
    java = 'package x;\npublic class A {\n  // void no() {}\n  private int f = g("}");\n  public String run(int a) throws E {\n    if (a > 0) { return other(a); }\n    return "run()";\n  }\n  abstract void decl(int b);\n}\n'
    found, calls = symbols.extract(src("A.java", java), "java")
    assert [(s["name"], s["kind"], s["parent"]) for s in found] == [("A", "class", None), ("run", "method", "A"), ("decl", "method", "A")]
    assert calls == [{"caller": "run", "callee": "other", "line": 6}]
    ts = "export class S {\n  async load(id: string): Promise<X> {\n    return this.http.fetchIt(id);\n  }\n}\nconst go = (a) => { load2(a); };\nexport interface I { a: string }\n"
    found, calls = symbols.extract(src("a.ts", ts), "typescript")
    assert {(s["name"], s["kind"], s["parent"]) for s in found} == {("S", "class", None), ("load", "method", "S"), ("go", "function", None), ("I", "type", None)}
    assert {(c["caller"], c["callee"]) for c in calls} == {("load", "fetchIt"), ("go", "load2")}
    assert [s["name"] for s in symbols.extract(src("a.go", "func (r *R) Do(x int) {}\ntype R struct {}\n"), "go")[0]] == ["Do", "R"]
    assert symbols.extract(src("bad.py", "def ok(a):\n  pass\ndef broken(:\n"), "python")[0][0]["name"] == "ok"


def test_imports_tests_and_lombok():
    assert symbols.imports(src("a.ts", "import { a } from './b';\nconst c = require(\"d/e\");"), "typescript") == ["./b", "d/e"]
    assert symbols.imports(src("a.py", "from x.y import z\nimport os.path"), "python") == ["os.path", "x.y"]
    assert symbols.imports(src("A.java", "import static a.b.C;\nimport d.E;"), "java") == ["a.b.C", "d.E"]
    assert [t["name"] for t in symbols.test_cases(src("a.spec.ts", "it('does it', () => {})\ntest.skip(\"no\", f)", True), "typescript")] == ["does it", "no"]
    assert [t["name"] for t in symbols.test_cases(src("T.java", "@Test\npublic void addsUp() {}", True), "java")] == ["addsUp"] and symbols.test_cases(src("T.java", "@Test void x() {}"), "java") == []
    names = [s["name"] for s in symbols.lombok(src("P.java", "@Data\n@Builder\npublic class P {\n private static final String K = \"k\";\n private boolean open;\n private List<String> tags;\n}"))]
    assert names == ["builder", "build", "isOpen", "setOpen", "getTags", "setTags"]


def test_files_are_freed_as_soon_as_they_are_read():
    src = Source("A.java", 'class A { void a() { jdbcTemplate.query("SELECT * FROM t"); b(); } }')
    gc.disable()
    try:
        assert [r["table"] for r in data.jvm_sites(src)] == ["t"] and http.jvm(src) == ([], [])
        held = weakref.ref(src)
        del src
        assert held() is None
    finally:
        gc.enable()


def test_only_calls_of_wanted_names_are_read():
    read = Source("A.java", "class A { void a() { x.y.b(1, c(2)); @d(3) e<T>(4); f(5).b(6); } }").read()
    found = read.calls_of(lambda name: name == "b")
    assert [(c.receiver, c.after is not None) for c in found] == [(("x", "y"), False), ((), True)] and len([m for m in read._made.values() if m]) == 2
    assert [c.name for c in read.calls] == ["a", "b", "c", "e", "f", "b"] and [c for c in read.calls if c.name == "b"] == found
