"""Route and file path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the language of each file name extension
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "cs": "csharp",
    "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "kt": "kotlin", "kts": "kotlin",
    "swift": "swift", "scala": "scala", "sql": "sql", "sh": "shell", "gradle": "config", "yaml": "config", "yml": "config", "properties": "config",
    "toml": "config", "json": "config", "xml": "config", "prisma": "config", "md": "docs", "pdf": "docs",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column, extra: dict[str, str] | None = None) -> Column:
    known = LANGUAGES | {k.lstrip(".").lower(): v for k, v in (extra or {}).items()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("other"))


def is_test(path: Column, test_patterns: tuple[str, ...] = (), production_patterns: tuple[str, ...] = ()) -> Column:
    """Whether a file is test code; the first rule that fits decides."""
    rules = [(p, False) for p in production_patterns]
    rules += [(r"(^|/)src/main/", False), (r"(^|/)src/(test|integrationTest|testFixtures)/", True), (r"(^|/)(test|tests|__tests__|__mocks__)/", True)]
    rules += [(r"(Test|Tests|IT|ITCase)\.(java|kt|kts)$", True), (r"\.(test|spec)\.(tsx?|mts|jsx?|mjs|cjs)$", True)]
    rules += [(r"(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$", True)] + [(p, True) for p in test_patterns]
    out = F.lit(False)
    for pattern, verdict in reversed(rules):
        out = F.when(F.rlike(path, F.lit(pattern)), F.lit(verdict)).otherwise(out)
    return out


def normalize_route(raw: Column) -> Column:
    """A route's comparable form: no scheme and host, no query, parameters as {}, one leading slash, none at the end."""
    p = F.regexp_replace(F.trim(raw), "(?i)^https?://[^/]+", "")
    p = F.regexp_replace(p, r"(?s)[?#].*$", "")
    for pattern in (r"\$\{[^}]*\}", r"\{[^}]*\}", r":[A-Za-z0-9_]+"):
        p = F.regexp_replace(p, pattern, "{}")
    p = F.regexp_replace(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)), "/{2,}", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)


def routes_match(endpoint: Column, call: Column) -> Column:
    """Whether a called path can reach an endpoint, segment by segment: {} on either side fits any segment; a call may start with an unknown
    base ({}), and may end in {**}, which fits what is left."""

    def fits(left: Column, right: Column) -> Column:
        open_end = F.element_at(right, -1) == "{**}"
        fixed = F.when(open_end, F.slice(right, 1, F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
        pairs = F.zip_with(F.slice(left, F.lit(1), F.size(fixed)), fixed, lambda a, b: (a == b) | (a == "{}") | (b == "{}"))
        same = F.when(open_end, F.size(left) >= F.size(fixed)).otherwise(F.size(left) == F.size(fixed))
        return same & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))

    def parts(c: Column) -> Column:
        return F.filter(F.split(c, "/"), lambda s: s != "")

    left, right = parts(endpoint), parts(call)
    direct = fits(left, right)
    stripped = (F.size(right) > 1) & (F.get(right, 0) == "{}") & fits(left, F.slice(right, 2, F.greatest(F.size(right) - 1, F.lit(1))))
    anything = (F.size(right) == 1) & (F.get(right, 0) == "{**}")
    empty = (F.size(right) == 0) | (F.size(left) == 0)
    return F.coalesce(F.when(anything, F.lit(True)).when(empty, F.size(left) == F.size(right)).otherwise(direct | stripped), F.lit(False))
