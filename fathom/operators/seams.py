"""Seams between repositories: topics, tables and routes, their two sides, and what is missing on one of them.

Message edges: path, topic, direction (produce, consume), line, resolved, via, system, source, is_test. Definitions: path, tbl, op, line, changeset, is_test.
Accesses: path, tbl, kind, mode, line, detail, source, is_test. Endpoints and calls: path, method, route, norm, line, detail, source, is_test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.paths import routes_match
from fathom.functions.text import site


def production(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_test"))


def topic_sides(edges: DataFrame) -> DataFrame:
    """topic, producers, consumers, unresolved, systems, orphan: production edges counted per topic."""
    out = production(edges).groupBy("topic").agg(
        F.count_if(F.col("direction") == "produce").alias("producers"), F.count_if(F.col("direction") == "consume").alias("consumers"),
        F.count_if(~F.col("resolved")).alias("unresolved"), F.array_sort(F.collect_set("system")).alias("systems"),
    )
    orphan = F.when(F.col("consumers") == 0, "produced but never consumed").when(F.col("producers") == 0, "consumed but never produced")
    return out.withColumn("orphan", orphan)


SITES = 50  # places shown of a side


def message_sites(edges: DataFrame, most: int = SITES) -> DataFrame:
    """topic, producers, consumers, unresolved_expressions, test_usage, the same with n_ before (how many there are), warning: each topic's places, as a tool shows them.

    The first `most` places of a side are shown, taken before any list is made, so a topic's places never stand in one row; the counts are of all.
    """
    asserted = F.when(F.startswith("source", F.lit("asserted:")), F.concat(F.lit("[ASSERTED by "), F.substring_index("source", ":", -1), F.lit("]")))
    place = site(F.col("path"), F.col("line"), F.when(F.col("via").isNotNull(), F.concat(F.lit("(via "), "via", F.lit(")"))), F.concat(F.lit("["), "system", F.lit("]")), asserted)
    names = ["producers", "consumers", "unresolved_expressions", "test_usage"]
    side = F.when(F.col("is_test"), names[3]).when(~F.col("resolved"), names[2]).when(F.col("direction") == "produce", names[0]).when(F.col("direction") == "consume", names[1])
    told = edges.select("topic", "path", "line", place.alias("site"), side.alias("side"))
    counts = told.groupBy("topic").agg(*[F.count_if(F.col("side") == n).alias(f"n_{n}") for n in names])
    first = Window.partitionBy("topic", "side").orderBy("path", "line", "site")
    shown = told.withColumn("_place", F.row_number().over(first)).where((F.col("_place") <= most) & F.col("side").isNotNull())
    listed = [F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("_place", "site")))), lambda s: s["site"]).alias(n) for n in names]
    none = F.array().cast("array<string>")
    out = counts.join(shown.groupBy("topic").agg(*listed), "topic", "left").withColumns({n: F.coalesce(n, none) for n in names})
    some = [F.col("n_producers") > 0, F.col("n_consumers") > 0]
    warning = F.when(some[0] & ~some[1], "produced but never consumed").when(some[1] & ~some[0], "consumed but never produced")
    tested = F.when(~some[0] & ~some[1] & (F.col("n_unresolved_expressions") == 0), "only tests use it")
    return out.withColumn("warning", F.coalesce(warning, tested)).select("topic", *names, *[f"n_{n}" for n in names], "warning")


def unused_declarations(declared: DataFrame, edges: DataFrame) -> DataFrame:
    """Topics that a configuration declares and no edge uses, tests and unresolved ones included."""
    return declared.join(edges.select("topic").distinct(), "topic", "left_anti")


def table_sides(defs: DataFrame, access: DataFrame) -> DataFrame:
    """tbl, ops, reads, writes, tests, warning: definitions and accesses of every table that either names."""
    d = defs.groupBy("tbl").agg(F.count("*").alias("ops"))
    a = access.groupBy("tbl").agg(
        F.count_if(~F.col("is_test") & F.col("mode").isin("read", "rw")).alias("reads"), F.count_if(~F.col("is_test") & F.col("mode").isin("write", "rw")).alias("writes"),
        F.count_if(F.col("is_test")).alias("tests"), F.count_if(~F.col("is_test")).alias("live"),
    )
    out = d.join(a, "tbl", "full_outer").na.fill(0, ["ops", "reads", "writes", "tests", "live"])
    drift = F.when((F.col("ops") == 0) & (F.col("live") > 0), "accessed but not defined").when(F.col("ops") == 0, "accessed but not defined (tests only)")
    return out.withColumn("warning", F.coalesce(drift, F.when(F.col("live") == 0, "defined but never accessed"))).drop("live")


def drift_sites(defs: DataFrame, access: DataFrame) -> DataFrame:
    """Production accesses of tables that nothing defines. A definition counts whatever it does and wherever it stands; NOT IN semantics without nulls."""
    return production(access).join(defs.select("tbl").where("tbl is not null").distinct(), "tbl", "left_anti")


def _segments(norm: Column) -> Column:
    return F.filter(F.split(norm, "/"), lambda s: s != "")


def _masked(parts: Column, mask: Column) -> Column:
    """The segments at places that a mask (as text, a digit a place) leaves, as one text."""
    return F.array_join(F.transform(parts, lambda s, i: F.when(F.substring(mask, i + 1, F.lit(1)) == "1", "").otherwise(s)), "/")


def _mask(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: F.when(s == "{}", "1").otherwise("0")), "")


def called(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """Pairs of an endpoint (columns e_*) and a call (c_*) that can reach it.

    Distinct routes are matched, not sites, and by equal keys: a route meets the other side's patterns of parameters (few, whatever the number of routes), and the
    segments that are literal on both sides are the key. Calls that may start with an unknown base are tried without it as well; those that end openly meet the
    endpoints' beginnings of their length. The wildcard test stays as the join's last word.
    """
    e = endpoints.select(*[F.col(c).alias(f"e_{c}") for c in endpoints.columns])
    c = calls.select(*[F.col(x).alias(f"c_{x}") for x in calls.columns])
    parts = _segments(F.col("c_norm"))
    open_ = F.coalesce(F.get(parts, F.size(parts) - 1) == "{**}", F.lit(False))
    right = c.select("c_method", "c_norm").distinct().select("c_method", "c_norm", parts.alias("_all"), open_.alias("open"))
    fixed = F.when(F.col("open"), F.slice("_all", F.lit(1), F.greatest(F.size("_all") - 1, F.lit(0)))).otherwise(F.col("_all"))
    based = (F.size("_all") > 1) & (F.get("_all", F.lit(0)) == "{}")
    bare = F.slice(fixed, F.lit(2), F.greatest(F.size(fixed) - 1, F.lit(0)))
    right = right.select("c_method", "c_norm", "open", F.explode(F.when(based, F.array(fixed, bare)).otherwise(F.array(fixed))).alias("p"))
    right = right.withColumns({"n": F.size("p"), "c_mask": _mask(F.col("p"))})
    left = e.select("e_method", "e_norm").distinct().withColumn("_all", _segments(F.col("e_norm")))
    wanted = right.select(F.col("c_method").alias("e_method"), "open", "n").distinct()  # lengths that are asked for
    length = (F.size("_all") == F.col("n")) | (F.col("open") & (F.size("_all") >= F.col("n")))
    left = left.join(F.broadcast(wanted), "e_method").where(length).select("e_method", "e_norm", "open", "n", F.slice("_all", F.lit(1), F.col("n")).alias("p"))
    left = left.withColumn("e_mask", _mask(F.col("p")))
    same = ["open", "n"]
    e_masks, c_masks = left.select(F.col("e_method").alias("c_method"), *same, "e_mask").distinct(), right.select(F.col("c_method").alias("e_method"), *same, "c_mask").distinct()
    both = F.array_join(F.zip_with(F.split("e_mask", ""), F.split("c_mask", ""), lambda a, b: F.when((a == "1") | (b == "1"), "1").otherwise("0")), "")
    left = left.join(c_masks, ["e_method", *same]).select("e_method", "e_norm", *same, "e_mask", "c_mask", _masked(F.col("p"), both).alias("key"))
    right = right.join(e_masks, ["c_method", *same]).select("c_method", "c_norm", *same, "e_mask", "c_mask", _masked(F.col("p"), both).alias("key"))
    pairs = left.withColumn("c_method", F.col("e_method")).join(right, ["c_method", *same, "e_mask", "c_mask", "key"])
    pairs = pairs.where(routes_match(F.col("e_norm"), F.col("c_norm"))).select("e_method", "e_norm", "c_method", "c_norm").distinct()
    return pairs.join(e, ["e_method", "e_norm"]).join(c, ["c_method", "c_norm"])


def uncalled(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """Production endpoints that no production call reaches."""
    hit = called(production(endpoints), production(calls)).select(F.col("e_method").alias("method"), F.col("e_norm").alias("norm")).distinct()
    return production(endpoints).join(hit, ["method", "norm"], "left_anti")


def unmatched(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls that reach no endpoint."""
    hit = called(endpoints, calls).select(F.col("c_method").alias("method"), F.col("c_norm").alias("norm")).distinct()
    return calls.join(hit, ["method", "norm"], "left_anti")


def gaps(edges: DataFrame, declared: DataFrame, defs: DataFrame, access: DataFrame, endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """category, subject, path, line: everything that stands on one side only."""
    live = production(edges)
    sides = topic_sides(edges)

    def as_gap(df: DataFrame, category: str, subject: Column) -> DataFrame:
        return df.select(F.lit(category).alias("category"), subject.alias("subject"), "path", F.col("line").cast("int").alias("line"))

    alone = live.join(sides.where("orphan is not null").select("topic", "orphan"), "topic")
    parts = [
        as_gap(live.where(~F.col("resolved")), "unresolved_topic_expressions", F.col("topic")),
        as_gap(alone.where("direction = 'produce' and orphan = 'produced but never consumed'"), "topics_produced_but_never_consumed", F.col("topic")),
        as_gap(alone.where("direction = 'consume' and orphan = 'consumed but never produced'"), "topics_consumed_but_never_produced", F.col("topic")),
        as_gap(drift_sites(defs, access), "tables_accessed_but_undefined", F.col("tbl")),
        as_gap(uncalled(endpoints, calls), "endpoints_with_no_caller", F.concat_ws(" ", "method", "norm")),
        as_gap(unused_declarations(declared, edges), "topics_declared_in_config_but_unused", F.col("topic")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def warned_first(df: DataFrame, warning: str, weight: list[Column], limit: int, keep_warned: bool = False) -> DataFrame:
    """The first rows, those with a warning before the others; keep_warned: no row with a warning is ever cut."""
    has = F.col(warning).isNotNull() & (F.col(warning) != "")
    if not keep_warned:
        return df.orderBy(has.desc(), *weight).limit(limit)
    return df.where(has).unionByName(df.where(~has).orderBy(*weight).limit(limit))
