"""URL filters by link-graph propagation, by DataFrame functions alone.

Hosts most of whose pages a rule blocks are blocked seeds; hosts with more allowed than blocked pages are trusted seeds. Over the graph of links between hosts, trust spreads along links by personalised
PageRank from the trusted seeds, and distrust spreads against them from the blocked seeds: who links to a blocked host is suspect. A host is
blocked if its distrust exceeds its trust by MARGIN of the share a seed gets. Where a rule fits a url, the rule decides (the longest that fits); the graph decides the rest.

Both walks run in one table of directed messages (from, to, share of trust, share of distrust), aggregated from links before any shuffle of hosts, written once; every
step is one equi-join and one partial aggregation over hosts, and is written. What reaches hosts without links goes back to the seeds. Steps end when no host's score
moves by more than a tenth of the margin. Hosts with very many links or pages are joined apart from the rest (`joined`).

Defined cases: a null url or one without "://" has an empty host and path, no rule fits it, and it is allowed; hosts that no link reaches have no score and
are allowed; links within a host do not count; relative links stay within the host; repeated rows are judged alike and their links count as often; a table without
links or without rows works; null pages have no links; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cleared, joined, written

DAMPING, STEPS, MARGIN = 0.85, 100, 0.01  # steps: 0.85**100 of a seed's mass is left to move, under any margin


@dataclass(frozen=True)
class Rule:
    text: str  # host/path prefix
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits; of equally long ones the first by text; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, counted."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^<>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    out = pages.select(url_host(F.col("url")).alias("src"), F.explode_outer(found).alias("link"))
    out = out.select("src", url_host(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return out.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def messages(edges: DataFrame) -> DataFrame:
    """at, to, st, sd: what share of its trust a host sends along each link, and of its distrust against it. edges: written."""
    total, zero = edges.count(), F.lit(0.0)
    out = edges.groupBy("src").agg(F.sum("n").alias("out"), F.count("*").alias("often"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("in"), F.count("*").alias("often"))
    sent = joined(edges, out.select("src", "out"), "src", out.select("src", F.col("often").alias("n")), total)
    received = joined(edges, into.select("dst", "in"), "dst", into.select("dst", F.col("often").alias("n")), total)
    along = sent.select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("n") / F.col("out")).alias("st"), zero.alias("sd"))
    against = received.select(F.col("dst").alias("at"), F.col("src").alias("to"), zero.alias("st"), (F.col("n") / F.col("in")).alias("sd"))
    return along.unionByName(against).groupBy("at", "to").agg(F.sum("st").alias("st"), F.sum("sd").alias("sd"))


def propagated(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING, margin: float = MARGIN) -> DataFrame:
    """host, trust, distrust, settled or after `steps` steps. seeds: host, trusted, blocked (0 or 1); each kind of seed holds mass 1 in all, if there are any."""
    spark, total = seeds.sparkSession, seeds.agg(F.sum("trusted").alias("nt"), F.sum("blocked").alias("nb")).first()
    nt, nb = float(total["nt"] or 0), float(total["nb"] or 0)
    scores = [F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")]
    keep: list[str] = []
    with cleared(spark, keep):
        start = seeds.select("host", (F.col("trusted") / F.lit(nt or 1.0)).alias("trust"), (F.col("blocked") / F.lit(nb or 1.0)).alias("distrust"))
        start, path = written(start.where("trust > 0 or distrust > 0"), "seeds")
        edges, _ = written(edges, "host-edges")
        sent, _ = written(messages(edges), "host-links")
        degrees, _ = written(sent.groupBy("at").agg(F.count("*").alias("n")), "host-degrees")
        in_all, now = sent.count(), start
        for _ in range(steps if in_all and (nt or nb) else 0):
            met = joined(sent, now.withColumnRenamed("host", "at"), "at", degrees, in_all)
            moved = met.select(F.col("to").alias("host"), (F.col("trust") * F.col("st") * damping).alias("trust"), (F.col("distrust") * F.col("sd") * damping).alias("distrust"))
            moved, _ = written(moved.groupBy("host").agg(*scores), "moved")
            held = moved.agg(F.coalesce(F.sum("trust"), F.lit(0.0)), F.coalesce(F.sum("distrust"), F.lit(0.0))).first()
            back = start.select("host", (F.col("trust") * F.lit(1 - held[0])).alias("trust"), (F.col("distrust") * F.lit(1 - held[1])).alias("distrust"))
            after, path = written(moved.unionByName(back).groupBy("host").agg(*scores), "host-scores")
            both = after.join(now.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d")), "host", "full_outer").na.fill(0.0)
            change = both.agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t")), F.abs(F.col("distrust") - F.col("d"))))).first()[0] or 0.0
            now = after
            if change < margin / max(nt, nb, 1.0) / 10:
                break
        keep.append(path)
    return now


def judged(pages: DataFrame, rules: list[Rule] | None = None, steps: int = STEPS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    rules = RULES if rules is None else rules
    if not rules:
        raise ValueError("without rules there are no seeds")
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)])
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    own = own.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    own = own.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    own = own.withColumn("by_rule", F.element_at(kind, F.coalesce("rule", F.lit(rules[0].text))))
    told = F.when(F.col("rule").isNotNull(), F.col("by_rule"))
    per_host = own.where("host <> ''").groupBy("host").agg(F.count_if(told == "allow").alias("a"), F.count_if(told == "block").alias("b"), F.count("*").alias("n"))
    edges = links(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    per_host, _ = written(per_host, "hosts")
    seeds = per_host.select("host", (F.col("a") > F.col("b")).cast("int").alias("trusted"), (F.col("b") * 2 > F.col("n")).cast("int").alias("blocked"))
    scored = per_host.select("host").join(propagated(edges, seeds, steps), "host", "left").na.fill(0.0, ["trust", "distrust"])
    count = seeds.agg(F.sum("blocked").alias("n")).first()["n"] or 1
    hosts = scored.select("host", "trust", "distrust")
    total = per_host.agg(F.sum("n")).first()[0] or 0
    out = joined(own.where("host <> ''"), hosts, "host", per_host.select("host", "n"), total)
    zero = F.lit(0.0)
    out = out.unionByName(own.where("host = ''").select("*", zero.alias("trust"), zero.alias("distrust")))
    method = F.when(F.col("distrust") - F.col("trust") > MARGIN / count, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("by_rule")).otherwise(method).alias("verdict"), "trust", "distrust")
