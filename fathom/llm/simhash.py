"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits over the XXH64 hashes (seed 42) of the text's 4-word shingles. Two fingerprints that differ in at most 4 bits differ in at most 4
of their 8 bytes, so they share at least 4 positional bytes: the guaranteed minimum. The inverted index posts distinct fingerprints under
positional bytes, three at a time: of any 4 positions, one of the 20 TRIPLES holds 3, so every link meets in a posting list, and lists are 65,536
times shorter than those of single bytes. Inside a list, shared positional bytes are tallied per pair; pairs under the minimum go, and the rest are verified by
their differing bits.

Only distinct fingerprints are indexed, so copies cost nothing here. A list leaves as a spanning forest of its links, at most one edge per member: members already
reached are not compared again, which keeps dense groups of near copies near linear, and all pairs are never emitted. A list over HOT
members is dealt into blocks, and every two blocks are compared in a task of their own, so no task holds an unbounded list.
Components come from alternating large and small stars over the edges, each round written to the shared folder. Hubs of the stars, hot fingerprints and hot groups are
joined apart from the rest (`joined`), and `one_of_each` shuffles no text: it marks rows by their places in the files.

Defined cases: a null or empty text, or one of white space, has fingerprint 0, which links like any other; a text of one to three words is one shingle; repeated
rows and repeated ids are nodes like others and share the smallest doc_id; a null doc_id gets a component but never names one, unless all are null; an empty
table gives no rows; other columns are not read by `near_duplicates`, and all are kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_views, chosen, cleared, dropped, joined, placed, written

SHINGLE, BITS, SEED = 4, 4, 42
LEAST = 8 - BITS  # positional bytes that linked fingerprints share
HOT = 50_000
SMALL = 12
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LANES = np.uint64(0x0101010101010101)


def triples() -> list[tuple[int, int, int]]:
    """20 position triples such that any 4 of 8 positions hold one: three classes of positions in a ring (3, 3, 2); a triple lies in
    a class, or has two of a class and one of the next."""
    of = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        kinds = sorted(of[p] for p in t)
        if len(set(kinds)) == 1:
            out.append(t)
        elif len(set(kinds)) == 2:
            twice = max(set(kinds), key=kinds.count)
            once = min(set(kinds), key=kinds.count)
            if once == (twice + 1) % 3:
                out.append(t)
    assert all(any(set(t) <= set(four) for t in out) for four in combinations(range(8), LEAST))
    return out


TRIPLES = triples()
#: for each set of equal bytes (a bit each), the first triple inside it
_FIRST = np.array([next((i for i, t in enumerate(TRIPLES) if all(m >> p & 1 for p in t)), 255) for m in range(256)], np.uint8)


def hashes(text: bytes) -> np.ndarray:
    import xxhash

    words = text.translate(_LOWER).split()  # on space and the control characters 9 to 13
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        return np.frombuffer(digest(joined, SEED), ">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(begins[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    starts = np.arange(0, len(h), 255)  # a lane of 8 bits counts to 255
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts).astype("<u8")
        counts[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the long columns in keep, and fp (the fingerprint as a signed long) of every row."""
    keep = keep or []
    columns = [F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("string").alias("text")]
    names = ["doc_id", *keep, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, sizes = byte_views(batch.column(batch.num_columns - 1))
            view = memoryview(raw)
            prints = np.array([fingerprint(hashes(bytes(view[a : a + n]))) for a, n in zip(starts.tolist(), sizes.tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64), pa.int64())], names)

    return docs.select(*columns).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def tallied(x: np.ndarray, y: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of fingerprints: whether they link, and their equal positional bytes as a bit mask."""
    apart = np.bitwise_xor(x, y)
    equal = np.ascontiguousarray(apart).astype("<u8").view(np.uint8).reshape(-1, 8) == 0
    link = np.count_nonzero(equal, axis=1) >= LEAST
    link[link] = np.bitwise_count(apart[link]) <= BITS
    return link, np.packbits(equal, axis=1, bitorder="little")[:, 0]


def forest(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the linked members of one posting list (distinct fingerprints): those not yet reached are compared with each that is."""
    out, left = [], x
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near, _ = tallied(left, p)
            if near.any():
                new, left = left[near], left[~near]
                out.append((np.full(len(new), p), new))
                queue.extend(new)
    return out


def list_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of posting lists. batches: (list, fp), sorted by list; a list's members may come in several batches."""
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        cut = np.flatnonzero(np.diff(key)) + 1
        begin = np.concatenate([[0], cut]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        long = size > SMALL
        # short lists: members d places apart, for all lists at once; a pair is taken only from the first list it meets in
        short = np.repeat(~long, size)
        k, f = key[short], fp[short]
        for d in range(1, SMALL):
            if len(k) <= d:
                break
            same = k[d:] == k[:-d]
            x, y, of = f[:-d][same], f[d:][same], k[d:][same]
            if not len(x):
                break
            link, mask = tallied(x, y)
            link &= _FIRST[mask] == ((of >> 24) & 0xFF)
            a.append(x[link])
            b.append(y[link])
        for i in np.flatnonzero(long):
            for x, y in forest(np.unique(fp[begin[i] : begin[i] + size[i]])):
                a.append(x)
                b.append(y)
        a, b = (np.concatenate([z.astype(np.uint64) for z in part]).view(np.int64) if part else np.zeros(0, np.int64) for part in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], ["u", "v"])

    for batch in batches:
        key = np.concatenate([held_key, np.asarray(batch.column(0))])
        fp = np.concatenate([held_fp, np.asarray(batch.column(1)).view(np.uint64)])
        if not len(key):
            continue
        done = int(np.searchsorted(key, key[-1], "left"))
        held_key, held_fp = key[done:], fp[done:]
        if done:
            yield linked(key[:done], fp[:done])
    if len(held_key):
        yield linked(held_key, held_fp)


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (u > v, signed) whose components are those of all links among distinct fingerprints. prints: fp, distinct."""

    def key(i: int, t: tuple[int, int, int]):
        byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF)) for p in t]
        return byte[0] + byte[1] * 256 + byte[2] * 65536 + F.lit(i << 24)

    index = prints.select("fp", F.explode(F.array(*[key(i, t) for i, t in enumerate(TRIPLES)])).alias("list"))
    large = index.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    large, path = written(large, "hot-lists")
    usual = index
    if not large.isEmpty():
        usual = index.join(large, "list", "left_anti")
        blocks = F.ceil(F.col("n") / F.lit(hot)).cast("int")
        dealt = index.join(large, "list").select("list", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
        dealt = dealt.select("list", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        # low byte triples keep their number in bits 24 to 31; the two blocks go above
        two = F.least("own", "other").cast("long") * (1 << 15) + F.greatest("own", "other")
        usual = usual.select("list", "fp").unionByName(dealt.select((F.col("list") + F.shiftleft(two + 1, 32)).alias("list"), "fp"))
    lists = usual.select(F.col("list").cast("long").alias("list"), "fp").repartition("list").sortWithinPartitions("list", "fp")
    return lists.mapInArrow(list_links, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that has an edge: root is its component's smallest node. edges: (u, v) with u > v."""
    spark = edges.sparkSession
    now, path = written(edges, "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = joined(both, least.select("u", "m"), "u", least.select("u", "n"), 2 * seen[0]).where("v > u and v <> m")
        large, large_path = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        again, again_path = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = joined(large, again.select("u", "m"), "u", again.select("u", "n"), 2 * seen[0]).where("v <> m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(again.select("u", F.col("m").alias("v")))
        after, new_path = written(small.distinct(), "stars")
        dropped(spark, path, least_path, large_path, again_path)
        now, path = after, new_path
        if (new := state(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes (fp, distinct, and other columns) with root, the smallest fingerprint that links reach. nodes: written."""
    labels = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    return nodes.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the rows that links reach) of every row."""
    prints, prints_path = written(fingerprints(docs), "fingerprints")
    nodes, nodes_path = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    keep = [prints_path, nodes_path]
    with cleared(docs.sparkSession, keep):
        known, _ = written(rooted(nodes), "roots")
        names, _ = written(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "groups")
        named = joined(known.select("root", "fp"), names.select("root", "component_id"), "root", names.select("root", "n"), known.count())
        named, path = written(named.select("fp", "component_id"), "named")
        keep.append(path)
    out = joined(prints, named, "fp", nodes.select("fp", "n"), prints.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of near duplicates: its smallest (doc_id, text hash), nulls last, the first in the files of equal ones."""
    rows, keep = placed(docs), []
    text = F.col("row.text").cast("string")
    read = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), "file", "at")
    with cleared(docs.sparkSession, keep):
        prints, _ = written(fingerprints(read, ["hash", "file", "at"]), "fingerprints")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "file", "at")).alias("first")
        nodes, _ = written(prints.groupBy("fp").agg(first), "nodes")
        kept, path = written(rooted(nodes).groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.at"), "kept")
        keep.append(path)
    out = chosen(rows, kept, keep=True)
    dropped(docs.sparkSession, path)
    return out
