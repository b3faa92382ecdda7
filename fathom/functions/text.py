"""Text functions as column expressions: they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Folds A-Z only, as embedded SQL engines do in LIKE."""
    return F.translate(c, UPPER, LOWER)


def like_folded(c: Column, pattern: str) -> Column:
    """LIKE with ASCII case folded; the caller's % and _ stay wildcards."""
    return ascii_lower(c).like(pattern.translate(str.maketrans(UPPER, LOWER)))


def line_count(text: Column) -> Column:
    """Lines as newlines plus one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset: newlines strictly before it, plus one."""
    return line_count(F.substring(text, F.lit(1), offset.cast("int")))


def module_of(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def snake(name: Column) -> Column:
    """OrderLine to order_line."""
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def spoken(name: Column) -> Column:
    """A test's name as words: names that already hold a space stay."""
    words = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "_", " ")
    return F.when(F.contains(name, F.lit(" ")), name).otherwise(F.lower(words))


def occurrences(text: Column, needle: str) -> Column:
    """Overlapping occurrences of a phrase, letter case folded.

    A phrase that can't overlap itself is counted by what removing it takes away; any other by a look-ahead, in the texts that hold it.
    """
    low, phrase = F.lower(text), needle.lower()
    if not any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase))):
        return ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")
    quoted = phrase.replace("\\E", "\\E\\\\E\\Q")
    return F.when(F.contains(low, F.lit(phrase)), F.regexp_count(low, F.lit(rf"(?=\Q{quoted}\E)"))).otherwise(0)


#: fixed values: words of a task's description that are no search terms
STOP_WORDS = """the and for with from that this then than when where which into onto over under about after before should would could will must make made
need needs want wants add use using used new our are was were has have had not but all any can its also only just some how why what who each per via one
two code file files""".split()


def task_terms(text: Column, most: int = 8) -> Column:
    """Search terms of a task: runs of at least three letters, digits, _ . $ -, lower-cased, without stop words, each once, the first `most`."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_.$-]{3,}"), F.lit(0))
    kept = F.filter(found, lambda t: ~t.isin(STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, most)


#: fixed values: words that follow a table keyword without being a table
SQL_NOISE = ["select", "dual", "values", "set", "where", "on"]


def sql_tables(sql: Column) -> Column:
    """Tables that a statement reads or writes: last dotted part, lower-cased, each once, in order."""
    hits = F.regexp_extract_all(sql, F.lit(r"""(?i)\b(?:from|join|into|update)\s+[`"]?([A-Za-z_][A-Za-z0-9_.]*)"""), F.lit(1))
    names = F.transform(hits, lambda h: F.lower(F.element_at(F.split(h, r"\."), -1)))
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(SQL_NOISE)))


def sql_mode(sql: Column) -> Column:
    return F.when(F.rlike(F.ltrim(sql), F.lit("(?i)^(insert|update|delete|merge|truncate)")), "write").otherwise("read")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def site(path: Column, line: Column, *notes: Column) -> Column:
    """path:line and notes, as reports show a place."""
    return F.concat_ws(" ", F.concat_ws(":", path, line.cast("string")), *notes)
