"""Extraction over a corpus: which extractor sees which file, and the tables that come out.

One pass over the texts runs every extractor on a file that has been read into tokens once, and emits rows of all tables under their names (`tag`). Names that cross files
(constants, entity tables, settings) are not looked up in it: rows of OPEN tables are sites, one row for each name that a site asks for (`wanted`). A join with the table of
names, as large as it may be, answers them, and a file's sites become its rows. No map of names stands on the driver or in a broadcast that Spark doesn't measure small.
An extractor that fails on a file gives no rows of its table, and a row of `failures` that says so.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from fathom.config import Config
from fathom.functions import paths
from fathom.operators.extract import data, http, messaging, symbols
from fathom.operators.extract.source import Source
from fathom.operators.graph import first_claim

SCHEMAS = {
    "symbols": "seq int, name string, kind string, line int, signature string, parent string",
    "calls": "caller string, callee string, line int",
    "imports": "module string",
    "test_cases": "name string, line int",
    "msg_edges": "topic string, direction string, line int, resolved boolean, via string, system string, source string",
    "msg_topics": "topic string, config_key string, line int",
    "db_defs": "tbl string, op string, line int, changeset string",
    "db_access": "tbl string, kind string, mode string, line int, detail string, source string",
    "http_endpoints": "method string, route string, norm string, line int, detail string, source string",
    "http_calls": "method string, route string, norm string, line int, detail string, source string",
}
JVM, WEB = ("java", "kt", "kts"), ("ts", "tsx", "js", "jsx", "mjs")
CHANGED = ("xml", "yml", "yaml", "sql", "prisma", "rb", "py")
#: suffixes of the files that may hold rows of a table, where not all may: a pass over such tables alone reads no others
HOLDING = {
    "msg_edges": (*JVM, *WEB, "py"), "msg_topics": ("yml", "yaml", "properties"), "db_defs": CHANGED, "db_access": (*JVM, *WEB, "py", "rb"),
    "http_endpoints": (*JVM, *WEB, "py"), "http_calls": (*JVM, *WEB, "py"),
}
#: tables whose rows may stand on names of other files
OPEN = ("msg_edges", "db_access")
#: texts of files that may hold symbols under names that don't stand in them
GENERATES = symbols.GENERATES.pattern
SHARED = "tag string, path string, key string, value string, at int"
#: message: a site as JSON, the place-th of its file's text (version)
SITE = "message string, place int, version long, wanted string"


def _columns(tables: Iterable[str], closed: bool) -> list[str]:
    """What rows of tables hold; closed: rows of OPEN tables are final."""
    held = [SITE if n in OPEN and not closed else SCHEMAS[n] for n in tables]
    return list(dict.fromkeys(c for schema in (*held, "message string") for c in schema.split(", ")))


def _mapped(corpus: DataFrame, rows: Callable[[Source], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (in the order of the schema) of a function of one file. corpus: path, text, is_test."""
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(*(c.to_pylist() for c in batch.columns))
            yield _batch([r for path, text, is_test in files for r in rows(Source(path, text, bool(is_test)))], out)

    return corpus.select("path", "text", "is_test").where("text is not null").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, kinds.get(kind) or to_arrow_type(StructType.fromDDL(f"x {kind}")[0].dataType)) for name, kind in (c.split(maxsplit=1) for c in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def table_function(corpus: DataFrame, rows: Callable[[Source], list[dict]], schema: str, gate: str | None = None, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path, is_test and the rows of a function of one file, for plug-ins: one that fails stops the job."""
    names = [c.split()[0] for c in schema.split(", ")]
    read = corpus
    if suffixes:
        read = read.where(paths.extension(F.col("path")).isin(*suffixes))
    if gate:
        read = read.where(F.rlike("text", F.lit(gate)))
    return _mapped(read, lambda s: ((s.path, s.is_test, *(r.get(n) for n in names)) for r in rows(s)), f"path string, is_test boolean, {schema}")


def _language(src: Source) -> str:
    return paths.LANGUAGES.get(src.suffix, "other")


def _symbols(src: Source) -> dict[str, list[dict]]:
    """symbols and calls of a file, which is parsed once."""
    found, calls = symbols.extract(src, _language(src))
    if src.suffix in JVM and "@" in src.text:
        found = found + symbols.lombok(src)
    return {"symbols": [s | {"seq": i} for i, s in enumerate(found)], "calls": calls}


def _imports(src: Source) -> dict[str, list[dict]]:
    return {"imports": [{"module": m} for m in symbols.imports(src, _language(src))]}


Finder = Callable[[Source], dict[str, list[dict]]]


def _static(rows: list[dict]) -> list[dict]:
    return [r | {"source": "static"} for r in rows]


def _own(src: Source) -> dict[str, str]:
    """Constants that a test file has for itself; they come before all others."""
    return {k: v for k, v, _ in reversed(messaging.constants(src))} if src.is_test else {}


#: sites of an OPEN table in Java and Kotlin code, and the rows of sites, by names, entities and settings
_SITES: dict[str, tuple[Callable[[Source], list], Callable[..., list[dict]]]] = {
    "msg_edges": (messaging.jvm_sites, lambda sites, names, entities, settings: messaging.edges_of(sites, settings, names)),
    "db_access": (data.jvm_sites, lambda sites, names, entities, settings: data.accesses_of(sites, entities, names)),
}


class _Asked(Mapping):
    """A map that knows nothing and remembers what it was asked for, except names that the file has itself."""

    def __init__(self, tag: str, asked: set[str], own: Mapping[str, str]):
        self.tag, self.asked, self.own = tag, asked, own

    def __getitem__(self, key: str) -> str:
        if key in self.own:
            return self.own[key]
        self.asked.add(f"{self.tag}:{key}")
        raise KeyError(key)

    def __contains__(self, key: object) -> bool:
        return self.get(key) is not None

    def __iter__(self) -> Iterator[str]:
        return iter(self.own)

    def __len__(self) -> int:
        return len(self.own)


def _opened(src: Source, table: str) -> dict[str, list[dict]]:
    """A file's sites of an OPEN table, one row for each name that a site asks for."""
    found, rows_of = _SITES[table]
    sites, own, asked = found(src), _own(src), set()
    maps = [_Asked("constants", asked, own), _Asked("entities", asked, {}), _Asked("settings", asked, {})]
    out, version = [], zlib.crc32(src.text.encode("utf-8", "surrogatepass"))
    for i, site in enumerate(sites):
        asked.clear()
        rows_of([site], *maps)  # what is looked up doesn't depend on what is found
        used = {k: own[k] for k in own if k in json.dumps(site, ensure_ascii=False)}
        told = json.dumps({"site": site, "own": used})
        out += [{"message": told, "place": i, "version": version, "wanted": w} for w in sorted(asked) or [f":{src.path}"]]  # no name begins so; it spreads the rest
    return {table: out}


def _told(rows: list[dict], src: Source) -> list[dict]:
    """Rows of an OPEN table that ask for no names, as its sites."""
    version = zlib.crc32(src.text.encode("utf-8", "surrogatepass"))
    return [{"message": json.dumps({"row": r}), "place": i, "version": version, "wanted": f":{src.path}"} for i, r in enumerate(rows)]


def _extractors(maps: tuple[Mapping[str, str], ...] | None) -> list[tuple[set[str], Callable[[Source], bool], Finder]]:
    """Tables, which files may hold rows of them, and the rows by table; without maps, sites of OPEN tables."""

    def gated(gate: str, *suffixes: str) -> Callable[[Source], bool]:
        rule = re.compile(gate)
        return lambda s: s.suffix in suffixes and rule.search(s.text) is not None

    def http_rows(src: Source) -> dict[str, list[dict]]:
        ends, calls = (http.jvm if src.suffix in JVM else http.web if src.suffix in WEB else http.python)(src)
        return {"http_endpoints": _static(ends), "http_calls": _static(calls)}

    def jvm(table: str) -> Finder:
        if maps is None:
            return lambda s: _opened(s, table)
        names, entities, settings = maps
        found, rows_of = _SITES[table]
        return lambda s: {table: _static(rows_of(found(s), {**names, **_own(s)} if s.is_test else names, entities, settings))}

    def plain(table: str, found: Callable[[Source], list[dict]]) -> Finder:
        return lambda s: {table: _told(found(s), s) if maps is None else _static(found(s))}

    return [
        ({"symbols", "calls"}, lambda s: True, _symbols),
        ({"imports"}, lambda s: True, _imports),
        ({"test_cases"}, lambda s: s.is_test, lambda s: {"test_cases": symbols.test_cases(s, _language(s))}),
        ({"msg_edges"}, gated(messaging.JVM_GATE, *JVM), jvm("msg_edges")),
        ({"msg_edges"}, gated(messaging.BROKER_GATE, *WEB, "py"), plain("msg_edges", messaging.broker_edges)),
        ({"msg_topics"}, lambda s: messaging.is_config(s.path), lambda s: {"msg_topics": messaging.declared(s, messaging.config(s))}),
        ({"db_defs"}, lambda s: s.suffix in CHANGED, lambda s: {"db_defs": data.changelog(s) if data.is_changelog(s) else data.schema_definitions(s)}),
        ({"db_access"}, gated(data.JVM_GATE, *JVM), jvm("db_access")),
        ({"db_access"}, gated(data.GENERIC_GATE, *WEB, "py", "rb"), plain("db_access", data.generic_access)),
        ({"http_endpoints", "http_calls"}, gated(http.GATE, *JVM, *WEB, "py"), http_rows),
    ]


def facts(corpus: DataFrame, *maps: Mapping[str, str], only: set[str] | None = None) -> DataFrame:
    """tag, path, is_test, columns of tables: the rows of all tables (or of those in `only`) in one pass over the texts. maps (names, entities, settings): small ones that are known before, with which rows
    of OPEN tables are final; without them they are sites, for `resolved`."""
    shared = corpus.sparkSession.sparkContext.broadcast(maps) if maps else None
    held = _columns([n for n in SCHEMAS if only is None or n in only], bool(maps))
    columns = [c.split()[0] for c in held]
    #: of each table, its columns and their places in a row
    places = {n: [(columns.index(c), c) for c in (x.split()[0] for x in _columns([n], bool(maps)))] for n in SCHEMAS if only is None or n in only}
    made: list = []  # the extractors, made once by each task's function

    def rows(src: Source) -> Iterator[tuple]:
        if not made:
            made.extend(x for x in _extractors(shared.value if shared else None) if only is None or x[0] & only)
        for tables, asked, extract in made:
            try:
                found = extract(src) if asked(src) else {}
            except Exception as e:
                yield ("failures", src.path, src.is_test, *(f"{'/'.join(sorted(tables))}: {type(e).__name__}: {e}"[:500] if c == "message" else None for c in columns))
                continue
            for tag, each in found.items():
                for r in each if only is None or tag in only else ():
                    row = [None] * len(columns)
                    for i, c in places[tag]:
                        row[i] = r.get(c)
                    yield (tag, src.path, src.is_test, *row)

    read = corpus
    if only is not None and only <= HOLDING.keys():
        read = read.where(paths.extension(F.col("path")).isin(*sorted({x for n in only for x in HOLDING[n]})))
    elif only == {"test_cases"}:
        read = read.where("is_test")
    return _mapped(read, rows, "tag string, path string, is_test boolean, " + ", ".join(held))


def table_of(found: DataFrame, name: str) -> DataFrame:
    """One table of facts."""
    schema = SCHEMAS.get(name, "message string")
    return found.where(F.col("tag") == name).select("path", "is_test", *[c.split()[0] for c in schema.split(", ")])


def structure(corpus: DataFrame) -> dict[str, DataFrame]:
    """symbols, calls, imports, test_cases."""
    names = ("symbols", "calls", "imports", "test_cases")
    found = facts(corpus, only=set(names))
    return {n: table_of(found, n) for n in names}


def resolved(found: DataFrame, names: DataFrame, table: str) -> DataFrame:
    """One of the OPEN tables from its sites and the table of names.

    Sites meet the names they ask for by an equal key, then those of a file come together: expressions, never texts.
    """
    schema = f"path string, is_test boolean, {SCHEMAS[table]}"
    columns, out = [c.split()[0] for c in SCHEMAS[table].split(", ")], _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(*(c.to_pylist() for c in batch.columns))
            yield _batch([(path, is_test, *(r.get(c) for c in columns)) for path, is_test, sites in files for r in _rows_of(table, sites)], out)

    sites = found.where(F.col("tag") == table).select("path", "is_test", "version", "place", "message", "wanted")
    met = sites.join(names.select("wanted", "value"), "wanted", "left")
    files = met.groupBy("path", "is_test", "version").agg(F.collect_list(F.struct("place", "message", "wanted", "value")).alias("sites"))
    return files.select("path", "is_test", "sites").mapInArrow(run, schema)


def _rows_of(table: str, sites: list[dict]) -> list[dict]:
    """A file's rows from its sites, in order, each with the names that it asked for."""
    maps: dict[str, dict[str, str]] = {"constants": {}, "entities": {}, "settings": {}}
    told: dict[tuple[int, str], dict] = {}
    for s in sites:
        told.setdefault((s["place"], s["message"]), json.loads(s["message"]))
        if s["value"] is not None:
            tag, _, key = s["wanted"].partition(":")
            maps[tag][key] = s["value"]
    ordered = [told[k] for k in sorted(told)]
    for t in ordered:
        maps["constants"] |= t.get("own", {})
    open_ = [t["site"] for t in ordered if "site" in t]
    return _static([t["row"] for t in ordered if "row" in t] + (_SITES[table][1](open_, *maps.values()) if open_ else []))


def shared_rows(corpus: DataFrame) -> DataFrame:
    """SHARED: constants, entities and settings, in one pass over the files that may hold any. Test files define neither constants nor entities for others; see `names_of`."""

    def rows(src: Source) -> Iterator[tuple]:
        try:
            if src.suffix in JVM and not src.is_test:
                yield from [("constants", src.path, k, v, i) for k, v, i in messaging.constants(src)]
                yield from [("entities", src.path, k, v, i) for k, v, i in data.entities(src)] if "@Entity" in src.text else ()
            elif messaging.is_config(src.path):
                yield from [("settings", src.path, k, v, i) for i, (k, v) in enumerate(messaging.config(src))]
        except Exception:  # the second pass tells of files that can't be read
            return

    suffix = paths.extension(F.col("path"))
    held = suffix.isin("yml", "yaml", "properties") | (suffix.isin(*JVM) & F.rlike("text", F.lit("final|const|@Entity")))
    return _mapped(corpus.where(held), rows, SHARED)


def names_of(shared: DataFrame, config: Config = Config()) -> DataFrame:
    """wanted (constants:, entities: or settings: and the name), value: of constants the first in path order wins, of entity tables and settings the last."""
    place = F.struct("path", "at")
    value = F.when(F.col("tag") == "constants", F.min_by("value", place)).otherwise(F.max_by("value", place))
    out = shared.groupBy("tag", "key").agg(value.alias("value")).select(F.concat_ws(":", "tag", "key").alias("wanted"), "value")
    if not config.table_name_overrides:
        return out
    said = [(f"entities:{k}", v.lower()) for k, v in config.table_name_overrides.items()]
    own = shared.sparkSession.createDataFrame(said, "wanted string, value string")
    return out.join(own.select("wanted"), "wanted", "left_anti").unionByName(own)


def tables_of(found: DataFrame | Mapping[str, DataFrame], shared: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """Tables of facts (made without maps; one for all, or one for each table) and shared rows."""
    names = names_of(shared, config)
    each = found if isinstance(found, Mapping) else dict.fromkeys((*SCHEMAS, "failures"), found)
    return {n: resolved(f, names, n) if n in OPEN else table_of(f, n) for n, f in each.items()}


def apart(corpus: DataFrame, tables: Iterable[str]) -> dict[str, DataFrame]:
    """Facts of each table by a pass of its own: for questions that read few of them."""
    return {n: facts(corpus, only={n}) for n in tables}


def seams(corpus: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """msg_edges, msg_topics, db_defs, db_access, http_endpoints, http_calls with path and is_test; each by a pass of its own over the files that may hold rows of it."""
    return tables_of(apart(corpus, ("msg_edges", "msg_topics", "db_defs", "db_access", "http_endpoints", "http_calls")), shared_rows(corpus), config)


#: in order: what a relative import may leave out
PROBES = ["", ".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", "/index.js", "/index.ts", "/index.tsx", "/__init__.py"]


def _resolved_path(path: Column, module: Column) -> Column:
    """Where a relative module lies: its steps are taken one by one from the file's folder; null if they leave the corpus."""
    folder = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    steps = F.filter(F.split(module, "/"), lambda s: (s != "") & (s != "."))

    def step(at: Column, s: Column) -> Column:
        up = F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1))
        return F.when(s == "..", up).otherwise(F.concat(at, F.array(s)))

    return F.array_join(F.aggregate(steps, folder, step), "/")


def import_edges(imports: DataFrame, files: DataFrame, config: Config = Config()) -> DataFrame:
    """src, dst, kind: imports that name a file of the corpus. Relative ones are tried with each of PROBES; others by the longest path they spell, which the
    first file in path order that ends in it claims."""
    relative = imports.where(F.startswith("module", F.lit("."))).select("path", _resolved_path(F.col("path"), F.col("module")).alias("base")).where("base is not null")
    tries = relative.select("path", "base", F.posexplode(F.array(*[F.concat(F.col("base"), F.lit(p)) for p in PROBES])).alias("rank", "dst"))
    known = tries.join(files.select(F.col("path").alias("dst")), "dst")
    first = first_claim(known, ["path", "base"], ["rank"]).select("path", "dst")
    plain = F.col("module")
    for prefix in reversed(config.alias_prefixes):
        plain = F.when(F.startswith("module", F.lit(prefix)), F.substring(F.col("module"), F.lit(len(prefix) + 1), F.length("module"))).otherwise(plain)
    tail = F.regexp_replace(F.regexp_replace(plain, r"::|\\", "/"), r"\.", "/")
    named = imports.where(~F.startswith("module", F.lit("."))).select("path", F.array_distinct(F.array(tail, F.regexp_replace(plain, r"::|\\", "/"))).alias("tails"))
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    parts = F.split(stem, "/")
    ends = files.select(F.col("path").alias("dst"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))
    claimed = ends.groupBy("tail").agg(F.min("dst").alias("dst"))
    other = named.select("path", F.explode("tails").alias("tail")).join(claimed, "tail").select("path", "dst")
    out = first.unionByName(other).where("path <> dst").distinct()
    return out.select(F.col("path").alias("src"), "dst", F.lit("import").alias("kind"))
