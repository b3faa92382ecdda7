"""Secret scans through a trigram index, by DataFrame functions alone.

Each rule's regular expression is analysed on the driver into a Boolean trigram query: a disjunction of alternatives, each a set of trigrams
that every match of that alternative contains. The index is inverted: the posting of a trigram names the documents that hold it, by their places in the files,
as pages of bits; it is built in one pass over the texts, combined before it is shuffled, and written. The postings of an alternative's trigrams are
intersected page by page, alternatives are united, and the documents whose bit is left are the rule's candidates. A second pass, in which the candidates' pages are broadcast,
runs a rule's expression on its candidates only. Rules without mandatory trigrams (`hex`) scan every document. No text is shuffled and nothing leaves the JVM.

Spans are code points, end exclusive. The base kinds `assign`, `access` and `hex` are found leftmost and non-overlapping, and a match that fails its
length is dropped without a retry. The method adds the kinds in EXTRA; a private key's span is its whole block. Places of matches are sums over blocks of matches, so
texts with very many of them take time in proportion. Redaction masks one kind after another, private keys first, in texts already masked.

Defined cases: a null text is empty and has no spans; texts are scanned whole, whatever their length; spans of different kinds may overlap, and all
are reported; repeated rows give repeated results; an empty table gives no rows; other columns are carried by `redacted` and not read otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound, is_marked, page_of, paged, placed, words_of, written

MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length is tested
    least: int = 1
    value: int = 0  # the group that redaction masks, if no group follows it in a match


BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
]
#: A key's block up to its END line; where another marker or the text's end comes first, the base64 and header lines that follow (line ends may be escaped).
#: Possessive, so that long keys need no deep stack.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:"
    r"(?:[^-]|-(?!----(?:BEGIN|END)\x20))*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:[\r\n]|\\[rn])++[\x20\t]*+[A-Za-z0-9+/]{1,15}+={0,2}(?![^\r\n\\])"
    r"|(?:\s|\\[rn])*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]{16,}+={0,2}))*+)"
)
EXTRA = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("private_key", PEM),
]


def trigram_query(pattern: str, limit: int = 24) -> list[frozenset[str]] | None:
    """Alternatives of trigrams, lower-cased, one of which every match holds in full; None if none are mandatory.

    Literal runs are followed through groups, alternations, small classes and optional characters; anything else ends a run.
    """
    import re._constants as c
    import re._parser as parser

    Strings = set[tuple[str, ...]]  # each: the literal runs of one way to match, where "" marks a break

    def chars(op, value) -> list[str] | None:
        if op is c.LITERAL:
            return [chr(value).lower()]
        if op is c.IN:
            found: set[str] = set()
            for kind, v in value:
                if kind is c.LITERAL:
                    found.add(chr(v).lower())
                elif kind is c.RANGE and v[1] - v[0] < 6:
                    found |= {chr(x).lower() for x in range(v[0], v[1] + 1)}
                else:
                    return None
            return sorted(found) if len(found) <= 6 else None
        return None

    def join(left: Strings, right: Strings) -> Strings:
        out: Strings = set()
        for a, b in product(left, right):
            out.add((*a[:-1], a[-1] + b[0], *b[1:]))
        return out if len(out) <= limit else {(*a, "") for a in left}

    def ways(parsed) -> Strings:
        out: Strings = {("",)}
        for op, value in parsed:
            if (letters := chars(op, value)) is not None:
                part: Strings = {(x,) for x in letters}
            elif op is c.SUBPATTERN:
                part = ways(value[3])
            elif op is c.BRANCH:
                part = set().union(*[ways(x) for x in value[1]])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
                least, most, inner = value
                once = ways(inner)
                if (least, most) == (0, 1):
                    part = once | {("",)}
                elif least:
                    part = {(*x, "", *x) if most != 1 else x for x in once}
                else:
                    part = {("", "")}
            else:
                part = {("", "")}
            out = join(out, part)
        return out

    found = []
    for runs in ways(parser.parse(pattern)):
        grams = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2) if run[i : i + 3].isascii())
        if not grams:
            return None
        found.append(grams)
    return [x for x in dict.fromkeys(found) if not any(y < x for y in found)]


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """gram (its number), file, page, word, bits: which documents hold each trigram, letter case aside. rows: as placed()."""
    page, word, bit = page_of()
    low = rows.select("file", page.alias("page"), word.alias("word"), bit.alias("bit"), F.lower(F.col("row.text").cast("string")).alias("low"))
    # an array with nulls, which compiles, and not the trigrams alone: whatever drops them first is interpreted, and folds the letters' case for each anew
    # (outer: else Spark infers a filter on the array's size and pushes it to the scan, where it does so as well)
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)])
    seen = low.select("file", "page", "word", "bit", held.alias("held")).select("file", "page", "word", "bit", F.explode_outer("held").alias("gram"))
    return seen.where("gram is not null").groupBy("gram", "file", "page", "word").agg(F.bit_or("bit").alias("bits"))


def intersected(index: DataFrame, queries: list[list[frozenset[str]] | None], grams: list[str]) -> DataFrame:
    """rule, file, page, word, bits: each rule's candidates, for rules with a query. A word of an alternative stands if all its trigrams' postings have it."""
    number = {g: k for k, g in enumerate(grams)}
    asked = [(i, a, number[g], len(need)) for i, q in enumerate(queries) if q for a, need in enumerate(q) for g in sorted(need)]
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, ("rule", "alternative", "gram", "need"))]) for row in asked])
    asked = index.sparkSession.range(1).select(F.inline(table))
    key = ["file", "page", "word"]
    met = index.join(F.broadcast(asked), "gram").groupBy("rule", "alternative", "need", *key)
    all_of = met.agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n")).where("n = need and bits <> 0")
    return all_of.groupBy("rule", *key).agg(F.bit_or("bits").alias("bits"))


def candidates(rows: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[Column]]:
    """Pages (file, page, rule0, rule1, ...: words) of the rules' candidates, written, and for each rule the test of a row that has met its page."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries if q for alternative in q for g in alternative})
    asked = [i for i, q in enumerate(queries) if q is not None]
    if not grams:
        none = rows.sparkSession.range(0).select(F.col("id").alias("file"), F.col("id").alias("page"))
        return none, [F.lit(True)] * len(rules)
    index, _ = written(postings(rows, grams), "postings")
    found = intersected(index, queries, grams)
    each = [F.collect_list(F.when(F.col("rule") == i, F.struct("word", "bits"))).alias(f"rule{i}") for i in asked]  # PAGE / 64 at most
    pages = found.groupBy("file", "page").agg(*each).select("file", "page", *[words_of(F.col(f"rule{i}")).alias(f"rule{i}") for i in asked])
    pages, _ = written(pages, "candidates")
    return pages, [is_marked(f"rule{i}") if i in asked else F.lit(True) for i in range(len(rules))]


SPAN = "struct<start:int,ord:int,end:int,kind:string>"
RUN = 128  # matches whose places are summed at a time


def _parts(text: Column, rule: Rule) -> Column:
    """gaps (one more than matches), full (matches) and tested (the group of each whose length counts)."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    return F.struct(F.split(text, rule.pattern, -1).alias("gaps"), whole.alias("full"), tested.alias("tested"))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<SPAN> of one rule's matches in a text, in time in proportion to them: places are summed in runs of RUN, and runs moved to where they begin."""

    def placed_in(parts: Column) -> Column:
        sizes = F.zip_with(F.slice(parts["gaps"], F.lit(1), F.size(parts["full"])), parts["full"], lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("match")))
        sizes = F.zip_with(sizes, parts["tested"], lambda s, t: F.struct(s["gap"].alias("gap"), s["match"].alias("match"), F.length(t).alias("tested")))
        return bound(sizes, lambda each: F.when(F.size(each) > 0, bound(runs(each), moved)).otherwise(F.array().cast(f"array<{SPAN}>")))

    def runs(each: Column) -> Column:
        def one(i: Column) -> Column:
            none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
            return F.aggregate(F.slice(each, i * RUN + 1, F.lit(RUN)), none, step)

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / RUN).cast("int")), one)

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + m["match"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind")).cast(SPAN)
        return F.struct(end.alias("at"), F.when(m["tested"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def moved(of: Column) -> Column:
        firsts = F.aggregate(of, F.array(F.lit(0)), lambda acc, r: F.array_append(acc, F.element_at(acc, -1) + r["at"]))

        def shifted(first: Column) -> Column:
            put = lambda s, by: F.struct((s["start"] + by).alias("start"), s["ord"].alias("ord"), (s["end"] + by).alias("end"), s["kind"].alias("kind")).cast(SPAN)
            return F.flatten(F.transform(of, lambda r, i: F.transform(r["out"], lambda s: put(s, F.get(first, i)))))

        return bound(firsts, shifted)

    return bound(_parts(text, rule), placed_in)


def _tightened(rule: Rule) -> Rule:
    """Where the tested group is all that repeats at a match's end, a too short match can't hide a longer one: the length moves into the expression."""
    if not rule.group and rule.least > 1 and rule.pattern.endswith("+"):
        head = rule.pattern[:-1]
        fixed = {"[0-9a-f]+": 0, "AKIA[A-Z0-9]+": 4, "gh[pousr]_[A-Za-z0-9]+": 4}.get(rule.pattern)
        if fixed is not None:
            return Rule(rule.kind, f"{head}{{{rule.least - fixed},}}", 0, rule.least, rule.value)
    return rule


def scanned(docs: DataFrame, rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep (columns of docs), text and secrets: array<struct(start, ord, end, kind)> by start, then kind as listed."""
    rules, rows = [_tightened(r) for r in rules or BASE + EXTRA], placed(docs)
    pages, asked = candidates(rows, rules)

    def verified(both: DataFrame) -> DataFrame:
        read = both.select(*[F.col(f"row.{k}").alias(f"_keep{i}") for i, k in enumerate(keep or [])], F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("_text"), *[c.alias(f"_asked{i}") for i, c in enumerate(asked)])
        none = F.array().cast(f"array<{SPAN}>")
        each = {f"_rule{i}": F.when(F.col(f"_asked{i}") & F.col("_text").rlike(r.pattern), rule_spans(F.col("_text"), r, i)).otherwise(none) for i, r in enumerate(rules)}
        out = read.withColumns(each)
        return out.select(*[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep or [])], F.col("_text").alias("text"), F.array_sort(F.concat(*each)).alias("secrets"))

    return paged(rows, pages, 64 + 96 * len(rules), verified)


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans."""
    base = F.filter("secrets", lambda s: s["ord"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["ord"] == i)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("secrets")).alias("spans"))


def masked(text: Column, rule: Rule) -> Column:
    """A text with the rule's values masked: its gaps and matches joined again."""

    def piece(gap: Column, full: Column, tested: Column) -> Column:
        head = F.substring(full, F.lit(1), F.length(full) - F.length(tested)) if rule.value else F.lit("")
        return F.concat(gap, F.when(F.length(tested) >= rule.least, F.concat(head, F.lit(MASK))).otherwise(full))

    def joined(parts: Column) -> Column:
        n = F.size(parts["full"])
        pairs = F.zip_with(F.slice(parts["gaps"], F.lit(1), n), parts["full"], lambda g, m: F.struct(g.alias("gap"), m.alias("full")))
        told = F.zip_with(pairs, parts["tested"], lambda p, t: piece(p["gap"], p["full"], t))
        return F.concat(F.array_join(told, ""), F.element_at(parts["gaps"], -1))

    return bound(_parts(text, rule), joined)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret's value masked in text, and n_chars, where there is such a column, made to fit; null texts stay null."""
    rules = sorted((_tightened(r) for r in BASE + EXTRA), key=lambda r: r.kind != "private_key")
    rows = placed(docs)
    pages, asked = candidates(rows, rules)

    def put(both: DataFrame) -> DataFrame:
        out = both.select("row", F.col("row.text").cast("string").alias("_text"), *[c.alias(f"_asked{i}") for i, c in enumerate(asked)])
        for i, r in enumerate(rules):
            out = out.withColumn("_text", F.when(F.col(f"_asked{i}") & F.col("_text").rlike(r.pattern), masked(F.col("_text"), r)).otherwise(F.col("_text")))
        hit = ~F.col("_text").eqNullSafe(F.col("row.text").cast("string"))
        new = {"text": F.col("_text")}
        if "n_chars" in docs.columns:
            new["n_chars"] = F.when(hit, F.length("_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
        return out.select(*[new.get(n, F.col("row").getField(n)).alias(n) for n in docs.columns])

    return paged(rows, pages, 64 + 96 * len(rules), put)
