"""Benchmark decontamination, by DataFrame functions alone.

A document is contaminated by an item if one of its item-sized windows (as many consecutive shingles as the item has) reaches a
weighted similarity of 0.8 with it: multiset Jaccard over shingles of five words, each weighing as often as it occurs. Words are the
runs of letters and digits, lower-cased.

1. Anchors. A window of similarity t shares at least t*n of an item's n shingles, so it holds one of any n - ceil(t*n) + 1 of them. The rarest
   of each item (by their count in the benchmark) are its anchors; a document's shingles meet them in a broadcast hash join, and every
   window that holds an anchor is made exactly once, from the first anchor in it. No window that could reach t is left out.
2. SimHash. Each window gets a 64-bit fingerprint; bit counts are kept in 16-bit lanes of 16 longs and rolled: a window's follow from the one before by the shingle
   that leaves and the one that enters.
3. Multi-index. 64 bits are cut into 12 blocks; of two fingerprints that differ in up to 23 bits, one block differs in at most one bit.
   Items are indexed under each block's value and all values one bit away, so every item with the window's anchors within 23 bits is found. At similarity
   0.8 a bit differs with probability 0.15, so 23 of 64 lie 4.8 standard deviations above the mean: the radius is wide on purpose.
4. Verification. The exact multiset similarity decides.

One pass over the documents without a shuffle of texts or shingles; only verified pairs are grouped. What an item puts into the broadcast tables (`_bytes`: its anchors,
its index values, its shingles once) is summed, and a benchmark beyond SLICE_BYTES takes several passes, each over the next slice of items. Windows of items over
MAX_SHINGLES shingles would be too many to make, so steps 1 to 4 give way to an exact count: the places where a document holds a shingle of the item are shuffled (of
documents long enough to reach t), and running sums over them give the similarity of every window as long as the whole item. They are broadcast SLICE_SHINGLES shingles
a pass, but an item never in parts. `clean` marks rows by their places in the files, so it shuffles no text either.

Defined cases: null texts hold no words; a text or item under five words is one shingle, its whole sequence; items without words match
nothing; a document shorter than the item is one window; repeated items give the same result, repeated documents (equal doc_id and text) one row; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound, chosen, dropped, placed, written

WORDS, SIMILARITY, RADIUS = 5, 0.8, 23
MAX_SHINGLES = 512
SLICE_BYTES, SLICE_SHINGLES = 128_000_000, 1_000_000
BLOCKS = [(5 * i + max(0, i - 8), 5 + (i >= 8)) for i in range(12)]  # first bit and width: eight of 5 bits, four of 6
LANES = 0x0001000100010001


def shingles(text: Column) -> Column:
    """Hashes of a text's shingles in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def joined(a: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(0), F.size(a) - WORDS), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(WORDS)]))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(a) >= WORDS, rolled).when(F.size(a) > 0, F.array(F.xxhash64(a))).otherwise(none)

    return bound(hashed, joined)


def _lane(h: Column, k: int) -> Column:
    """Bits k, k + 16, k + 32 and k + 48 of a hash as four counts of 16 bits."""
    return F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))


def _print(lanes: list[Column], of: Column) -> Column:
    """The 64-bit SimHash of bit counts in lanes, where a bit is set if over half of the hashes have it."""
    zero, out = F.lit(0).cast("long"), None
    for j in range(4):
        for k in range(16):
            bit = F.when(F.shiftrightunsigned(lanes[k], 16 * j).bitwiseAND(F.lit(0xFFFF)) * 2 > of, F.shiftleft(F.lit(1).cast("long"), 16 * j + k)).otherwise(zero)
            out = bit if out is None else out.bitwiseOR(bit)
    return out


def counted(hashes: Column) -> list[Column]:
    """Bit counts of at most 65,535 hashes, in lanes."""

    def lane(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + _lane(h, k))

    return [lane(k) for k in range(16)]


def with_fingerprint(df: DataFrame, hashes: str, name: str) -> DataFrame:
    wide = df.withColumns({f"_lane{k}": lane for k, lane in enumerate(counted(F.col(hashes)))})
    names = [f"_lane{k}" for k in range(16)]
    return wide.withColumn(name, _print([F.col(n) for n in names], F.size(hashes))).drop(*names)


def rolled(local: Column, low: Column, high: Column, m: Column) -> Column:
    """Fingerprints of the windows of m hashes that start at low to high of an array, as array<struct(start, print)>."""
    lanes = "struct<" + ",".join(f"l{k}:bigint" for k in range(16)) + ">"

    def step(acc: Column, start: Column) -> Column:
        out, into = F.get(local, start - 1), F.get(local, start + m - 1)
        moved = [acc["lanes"][f"l{k}"] + _lane(into, k) - _lane(out, k) for k in range(16)]
        after = F.when(start == low, acc["lanes"]).otherwise(F.struct(*[x.alias(f"l{k}") for k, x in enumerate(moved)]))
        return bound(after, lambda now: F.struct(now.alias("lanes"), F.array_append(acc["prints"], _print([now[f"l{k}"] for k in range(16)], m)).alias("prints")))

    begin = F.struct(*[x.alias(f"l{k}") for k, x in enumerate(counted(F.slice(local, low + 1, m)))]).cast(lanes)
    first = F.struct(begin.alias("lanes"), F.array().cast("array<bigint>").alias("prints"))
    prints = F.aggregate(F.sequence(low, high), first, step, lambda acc: acc["prints"])
    return F.transform(prints, lambda p, i: F.struct((low + i).alias("start"), p.alias("print")))


def block(value: Column, i: int) -> Column:
    first, width = BLOCKS[i]
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two arrays of hashes, 0 if both are empty."""

    def rest(x: Column) -> Column:  # every occurrence but the first of each
        return bound(F.array_sort(x), lambda s: F.filter(s, lambda v, i: (i > 0) & (v == F.get(s, i - 1))))

    def common(ra: Column, rb: Column) -> Column:
        often = F.transform(
            F.array_intersect(ra, rb), lambda v: F.least(F.size(F.filter(ra, lambda y: y == v)), F.size(F.filter(rb, lambda y: y == v)))
        )
        return F.size(F.array_intersect(a, b)) + F.aggregate(often, F.lit(0), lambda s, v: s + v)

    both = bound(F.struct(rest(a).alias("a"), rest(b).alias("b")), lambda r: common(r["a"], r["b"]))
    return F.when(F.size(a) + F.size(b) > 0, bound(both, lambda c: c / (F.size(a) + F.size(b) - c))).otherwise(F.lit(0.0))


def sized(items: DataFrame) -> DataFrame:
    """seg, item_id, n, sh: each item's shingles, whole; equal items of one id once."""
    read = items.select(F.col("item_id").cast("long").alias("item_id"), shingles(F.col("text")).alias("sh")).where(F.size("sh") > 0)
    return read.select(F.xxhash64("item_id", "sh").alias("seg"), "item_id", F.size("sh").alias("n"), "sh").dropDuplicates(["seg", "item_id"])


def _anchors(n: Column, threshold: float) -> Column:
    return (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int")


def _bytes(n: Column, threshold: float) -> Column:
    """About what an item puts into the broadcast tables of a pass: a row for each anchor, its anchors, a row for each index value, its shingles."""
    return _anchors(n, threshold).cast("long") * (64 + 8) + 64 * (12 + sum(w for _, w in BLOCKS)) + 64 + 8 * n.cast("long")


def _slices(parts: DataFrame, share: float) -> list[DataFrame]:
    """parts in as many slices as the share, rounded up; one at least."""
    passes = max(1, math.ceil(share))
    return [parts] if passes == 1 else [parts.where(F.pmod("seg", F.lit(passes)) == k) for k in range(passes)]


def contaminated(docs: DataFrame, items: DataFrame, keys: list[str] | None = None, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: keys, item_id, similarity (the best window's), start_shingle (that window's first shingle), windows
    (verified ones). keys: the columns of docs that name a document, besides text; doc_id as a long unless given."""
    keys = keys or ["doc_id"]
    parts = sized(items)
    short, long = parts.where(F.col("n") <= MAX_SHINGLES), parts.where(F.col("n") > MAX_SHINGLES)
    is_short = F.col("n") <= MAX_SHINGLES
    told = parts.agg(F.sum(F.when(is_short, _bytes(F.col("n"), threshold))).alias("short"), F.sum(F.when(~is_short, F.col("n"))).alias("long")).first()
    if not told["short"]:
        short = short.limit(0)
    read = docs.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], shingles(F.col("text")).alias("sh"))
    found = None
    for part in _slices(short, (told["short"] or 0) / SLICE_BYTES):
        one = _pass(read, part, len(keys), threshold)
        found = one if found is None else found.unionByName(one)
    if told["long"]:
        for part in _slices(long, told["long"] / SLICE_SHINGLES):
            found = found.unionByName(_long_pass(read, part, len(keys), threshold))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    passed = F.sum("passed").alias("windows")
    grouped = found.groupBy(*[f"_key{i}" for i in range(len(keys))], "item_id").agg(best.alias("best"), passed).where("windows > 0")
    return grouped.select(
        *[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], "item_id", F.col("best.similarity").alias("similarity"),
        (-F.col("best.back")).cast("long").alias("start_shingle"), "windows",
    )


def _pass(read: DataFrame, parts: DataFrame, n_keys: int, threshold: float) -> DataFrame:
    """Windows and the items within RADIUS of them, with their exact similarity."""
    keys = [f"_key{i}" for i in range(n_keys)]
    # anchors: the rarest shingles of each item; items with the same ones and of one size share a set
    each = parts.select("seg", "n", F.posexplode_outer("sh").alias("q", "h"))
    each = each.join(each.groupBy("h").agg(F.count("*").alias("often")), "h")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("often", "h", "q"))), F.lit(1), _anchors(F.first("n"), threshold))
    anchors = each.groupBy("seg").agg(F.first("n").alias("n"), F.array_sort(F.array_distinct(F.transform(rarest, lambda x: x["h"]))).alias("anchors"))
    anchors = anchors.select("seg", "n", "anchors", F.xxhash64("n", "anchors").alias("set"))
    sets = anchors.select("set", "n", "anchors").dropDuplicates(["set"])
    probe = sets.select(F.explode("anchors").alias("h"), "set")
    # windows that hold an anchor, each from the first of its set in it. What follows the join keeps to functions that compile, and
    # takes the anchor's surroundings only: no row repeats a document's shingles. (outer: else Spark infers a filter on the array's size, pushes it
    # to the scan and shingles every text twice; windows are filtered after the explode, as a filter above the join would become its condition)
    met = read.select(*keys, "sh", F.posexplode_outer("sh").alias("p", "h")).join(F.broadcast(probe), "h").join(F.broadcast(sets), "set")
    near, total = F.greatest(F.lit(0), F.col("p") - F.col("n") + 1), F.size("sh")
    met = met.select(
        *keys, "set", "anchors", "p", near.alias("base"), F.least(F.col("n"), total).alias("m"),
        F.least(F.col("p"), total - F.least(F.col("n"), total)).alias("high"), F.slice("sh", near + 1, F.col("n") * 2 - 1).alias("local"),
    )
    earlier = F.transform(F.slice("local", F.lit(1), F.col("p") - F.col("base")), lambda h, i: F.when(F.array_contains("anchors", h), i).otherwise(F.lit(-1)))
    after = F.col("base") + F.coalesce(F.array_max(earlier), F.lit(-1)) + 1
    low = F.greatest(after, F.col("p") - F.col("m") + 1)
    met = met.select(*keys, "set", "m", "base", "local", (low - F.col("base")).alias("low"), (F.col("high") - F.col("base")).alias("high"))
    starts = F.when(F.col("low") <= F.col("high"), rolled(F.col("local"), F.col("low"), F.col("high"), F.col("m")))
    windows = met.select(*keys, "set", "m", "base", "local", F.explode_outer(starts).alias("w")).where("w is not null")
    windows = windows.select(*keys, "set", "m", "base", "local", "w.start", "w.print")
    # items under every value of each block within one bit
    index = with_fingerprint(parts.select("seg", "sh"), "sh", "item_print").drop("sh").join(anchors.select("seg", "set"), "seg")
    variants = [
        F.struct(F.lit(i).alias("blk"), block(F.col("item_print"), i).bitwiseXOR(F.lit(flip)).alias("val"))
        for i, (_, width) in enumerate(BLOCKS)
        for flip in [0, *[1 << b for b in range(width)]]
    ]
    index = index.select("seg", "set", "item_print", F.inline(F.array(*variants)))
    asked = [F.struct(F.lit(i).alias("blk"), block(F.col("print"), i).alias("val")) for i in range(len(BLOCKS))]
    pairs = windows.select(*keys, "set", "m", "base", "local", "start", "print", F.inline(F.array(*asked))).join(F.broadcast(index), ["set", "blk", "val"])
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    # each pair once: under the first block that differs in at most one bit
    first = F.lit(len(BLOCKS))
    for i in reversed(range(len(BLOCKS))):
        first = F.when(F.bit_count(block(apart, i)) <= 1, F.lit(i)).otherwise(first)
    pairs = pairs.where(F.bit_count(apart) <= RADIUS).where(F.col("blk") == first).join(F.broadcast(parts.select("seg", "item_id", F.col("sh").alias("item_sh"))), "seg")
    win = F.slice("local", F.col("start") + 1, F.col("m"))
    pairs = pairs.select(*keys, "item_id", (F.col("base") + F.col("start")).alias("start"), bound(win, lambda w: similarity(w, F.col("item_sh"))).alias("similarity"))
    return pairs.withColumn("passed", (F.col("similarity") >= threshold - 1e-12).cast("long"))


def _long_pass(read: DataFrame, parts: DataFrame, n_keys: int, threshold: float) -> DataFrame:
    """Items of any size with every window of each document, counted without making the windows.

    Of a shingle that an item holds k times, the occurrence at p is among the first k in a window of m shingles if the window starts at p at the latest, after
    p - m, and after the k-th occurrence before p. So each occurrence counts for one range of starts, and running sums over the ends of
    these ranges give every window's multiset intersection.
    """
    keys = [f"_key{i}" for i in range(n_keys)]
    pair = [*keys, "doc", "seg", "item_id", "n", "total"]
    asked = parts.select("seg", "item_id", "n", F.explode("sh").alias("h")).groupBy("seg", "item_id", "n", "h").agg(F.count("*").cast("int").alias("k"))
    least = parts.agg(F.min("n")).first()[0]
    # (outer, as in _pass; documents too short for the smallest item give one null row)
    places = F.when(F.size("sh") >= F.lit(least) * threshold - 1e-9, F.col("sh"))
    met = read.select(*keys, F.xxhash64("sh").alias("doc"), F.size("sh").alias("total"), F.posexplode_outer(places).alias("p", "h"))
    met = met.join(F.broadcast(asked), "h").where(F.col("total") >= F.col("n") * F.lit(threshold) - 1e-9)
    met = met.groupBy(*pair, "h", "k").agg(F.array_sort(F.collect_set("p")).alias("at"))  # a set: repeated documents are one
    m = F.least("n", "total")
    low = lambda p, i: F.greatest(F.lit(0), p - m + 1, F.when(i >= F.col("k"), F.get("at", i - F.col("k")) + 1))
    ranges = F.transform("at", lambda p, i: F.struct(low(p, i).alias("low"), F.least(p, F.col("total") - m).alias("high")))
    ranges = F.filter(ranges, lambda r: r["low"] <= r["high"])
    ends = F.flatten(F.transform(ranges, lambda r: F.array(F.struct(r["low"].alias("start"), F.lit(1).alias("d")), F.struct((r["high"] + 1).alias("start"), F.lit(-1).alias("d")))))
    turns = met.select(*pair, F.inline(ends)).groupBy(*pair, "start").agg(F.sum("d").alias("d"))
    along = Window.partitionBy(*pair).orderBy("start")
    turns = turns.withColumns({"c": F.sum("d").over(along), "wide": F.lead("start").over(along) - F.col("start")}).where("c > 0")
    out = turns.select(*keys, "item_id", "start", "wide", (F.col("c") / (F.col("n") + m - F.col("c"))).alias("similarity"))
    return out.select(*keys, "item_id", "start", "similarity", F.when(F.col("similarity") >= threshold - 1e-12, F.col("wide")).otherwise(F.lit(0)).cast("long").alias("passed"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates."""
    rows, spark = placed(docs), docs.sparkSession
    read = rows.select("file", "at", F.col("row.text").alias("text"))
    bad, path = written(contaminated(read, items, ["file", "at"]).select("file", "at").distinct(), "contaminated")
    out = chosen(rows, bad, keep=False)
    dropped(spark, path)
    return out
