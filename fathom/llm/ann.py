"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are normalised and turned by a random rotation, so that the first d of D dimensions give an unbiased estimate of a distance. An inverted-file index,
fitted on a bounded sample, assigns every distinct vector to a list; the number of lists grows with the square root of the table, and how many of them a query
probes is measured on the sample: the fewest that hold TARGET of the true neighbours there. Inside a list, rotated vectors lie in blocks of columns. A query
starts without a bound; rows come in chunks, all of them meet the first block of columns, and after each block a hypothesis test abandons the candidates whose
partial distance, scaled to all dimensions, exceeds the query's k-th best so far by more than chance allows. What finishes tightens the bound for the next chunk. The nearest
list is scanned first, and its bound is carried into the other probed lists. Survivors are scored exactly: cosine in double precision on the original vectors.

No list, however hot, lies in one task. Equal vectors are one entry of the index with the few smallest ids that can be a result, aggregated before the shuffle;
a list's entries are dealt into blocks of BLOCK_BYTES by a hash, and only where over QUERY_ROWS queries meet a list is the list met by several parts of them.
The fitted index (centroids and the rotation) is small and bounded.

Defined cases: vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components take no part, nor do rows with a null vec_id; a vec_id
that repeats is a query once (its smallest vector), its own rows are never candidates of it, and among others each row counts; ties go to the smaller vec_id;
a query for which the probed lists hold fewer than k candidates is asked of all lists, so only a table with fewer gives fewer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, under, written

SAMPLE, MAX_LISTS, PER_LIST = 20_000, 4096, 16  # the sample grows beyond SAMPLE where the lists need as many vectors each
TARGET, ASKED = 0.96, 256  # share of the sample's true neighbours that the probed lists must hold, and with how many queries it is measured
CHUNK, QUERY_CHUNK = 512, 256  # rows and queries that meet at a time
DIM_BLOCK, CHANCE = 16, 2.1  # columns scanned between tests; the test's width in standard errors
K, EVERY = 5, 50
QUERY_ROWS, BLOCK_BYTES = 16_384, 16_000_000
RESULT = "query_id long, vec_id long, n int, score double"


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, lists: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """k-means of unit vectors; empty lists keep their last centre."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=lists)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centre.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def ordered(q: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Lists from the nearest to the farthest, for each query."""
    return ((centre * centre).sum(axis=1)[None] - 2 * q @ centre.T).argsort(axis=1, kind="stable")


def probed(x: np.ndarray, centre: np.ndarray, k: int, target: float = TARGET) -> int:
    """How many lists, the nearest first, hold the target share of the sample's true neighbours."""
    asked = x[np.random.default_rng(9).choice(len(x), min(len(x), ASKED), replace=False)]
    gap = 2 - 2 * asked @ x.T
    gap[gap < 1e-12] = np.inf  # itself and its copies
    k = min(k, len(x) - 1)
    if k < 1:
        return len(centre)
    true = np.argpartition(gap, k - 1, axis=1)[:, :k]
    place = np.empty((len(asked), len(centre)), np.int64)
    np.put_along_axis(place, ordered(asked, centre), np.arange(len(centre))[None], axis=1)
    at = np.sort(np.take_along_axis(place, nearest(x, centre)[true], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1


def limits(bound: np.ndarray, seen: int, dim: int) -> np.ndarray:
    """The largest partial distances over `seen` of dim columns that are no evidence of a distance beyond the bounds."""
    return bound * (seen / dim) * (1 + CHANCE / np.sqrt(seen)) ** 2 + 1e-9 if seen < dim else bound + 1e-9


def scan(q: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray, own: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """Pairs (query, row) of rotated unit vectors that may be among the query's k nearest, the queries' new bounds, and counts of the work done.

    own(rows, queries): which of these pairs are left out. bound: each query's k-th best squared distance so far (inf: none known).
    """
    dim, bound = x.shape[1], bound.copy()
    first = min(dim, DIM_BLOCK)
    q2, x2 = (q[:, :first] ** 2).sum(axis=1), (x[:, :first] ** 2).sum(axis=1)
    best = np.full((len(q), k), np.inf)
    out_q, out_x, out_d = [], [], []
    work = {"met": 0, "abandoned": 0, "finished": 0}
    for at in range(0, len(x), CHUNK):
        rows = slice(at, at + CHUNK)
        partial = x2[rows, None] + q2 - 2 * x[rows, :first] @ q[:, :first].T
        r, j = np.nonzero(partial <= limits(bound, first, dim))
        work["met"] += partial.size
        so_far, d = partial[r, j], first
        r = r + at
        left = ~own(r, j)
        r, j, so_far = r[left], j[left], so_far[left]
        while d < dim and len(r):
            so_far = so_far + ((x[r, d : d + DIM_BLOCK] - q[j, d : d + DIM_BLOCK]) ** 2).sum(axis=1)
            d = min(dim, d + DIM_BLOCK)
            stays = so_far <= limits(bound, d, dim)[j]
            r, j, so_far = r[stays], j[stays], so_far[stays]
        work["finished"] += len(r)
        if len(r):
            out_q.append(j)
            out_x.append(r)
            out_d.append(so_far)
            new = np.full((len(q), min(CHUNK, len(x) - at)), np.inf)
            new[j, r - at] = so_far
            best = np.partition(np.hstack([best, new]), k - 1, axis=1)[:, :k]
            bound = np.minimum(bound, best.max(axis=1))
    work["abandoned"] = work["met"] - work["finished"]
    if not out_q:
        none = np.zeros(0, np.int64)
        return none, none, bound, work
    j, r, d = np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_d)
    stays = d <= bound[j] + 1e-9
    return j[stays], r[stays], bound, work


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, so that equal rows get equal scores."""
    size = np.abs(x).max(axis=1, initial=0)
    big, own = (size > 1e100) | (size < 1e-100), np.abs(q).max()
    if big.any() or not 1e-100 < own < 1e100:  # else squares overflow or vanish
        x, q = x / size[:, None], q / own
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def _valid(df: DataFrame) -> DataFrame:
    """vec_id, v; vectors of floats stay floats, half as wide."""
    kind = "float" if dict(df.dtypes)["embedding"] == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    read = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return read.where(F.exists("v", lambda c: c != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def sampled(read: DataFrame, total: int, most: int | None = None) -> pa.ChunkedArray:
    """At most SAMPLE (or `most`) of the vectors (vec_id, v), the first by a hash of id and vector.

    A share of the hash's range is looked through, so that hardly more than the sample leaves the executors, and a wider one while too few rows lie in it:
    repeated rows share a hash.
    """
    most = most or SAMPLE
    hashed, share = F.xxhash64("vec_id", "v"), (1.25 * most + 64) / total
    while True:
        some = read.where(under(hashed, share))
        rows = some.orderBy(hashed, "vec_id").limit(most).select("v").toArrow().column(0)
        if len(rows) >= min(most, total) or share >= 1:
            return rows
        share *= 16


def entries(read: DataFrame, k: int) -> DataFrame:
    """v, ids: distinct vectors with the smallest of their ids, each with the number of its rows, k at most.

    Of k + 1 ids one may be the query's own, and k rows are left that stand before any other row with this vector. Both steps combine before they shuffle.
    """
    hashed = read.select("vec_id", "v", F.xxhash64("v").alias("h"))
    counted = hashed.groupBy("vec_id", "h", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    some = counted.withColumn("place", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    return some.groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids")).drop("h")  # k + 1 at most


def kept_of(ids: np.ndarray, counts: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows, nearest first; counts: rows that a place stands for."""
    order = np.lexsort((ids, -score))
    before = np.cumsum(counts[order]) - counts[order]
    return order[before < k]


def neighbours(vectors: DataFrame, every: int = EVERY, k: int = K, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest by cosine. probes: lists to probe, measured unless given."""
    spark = vectors.sparkSession
    read = _valid(vectors)
    total = read.count()
    lists = min(MAX_LISTS, max(1, round(total**0.5 / 4)))
    rows = sampled(read, total, max(SAMPLE, PER_LIST * lists)) if total else []
    if not len(rows):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.asarray(rows.combine_chunks().value_lengths())
    dim = int(np.bincount(lengths).argmax())
    turn = rotation(dim)
    fit = unit(_matrix(rows.filter(pa.array(lengths == dim)))) @ turn
    centre = centroids(fit, min(len(fit), lists))
    probes = min(len(centre), probes or probed(fit, centre, k))
    kind = dict(read.dtypes)["v"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = nearest(unit(_matrix(batch.column(0))) @ turn, centre) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], ["v", "ids", "list"])

    same = read.where(F.size("v") == dim)
    index, index_path = written(entries(same, k).mapInArrow(listed, f"v {kind}, ids array<struct<vec_id:bigint,n:int>>, list int"), "ann-lists")
    per_block = max(CHUNK, BLOCK_BYTES // (8 * dim))
    counts = np.zeros(len(centre), np.int64)
    for r in index.groupBy("list").count().collect():  # MAX_LISTS rows at most
        counts[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-counts // per_block))
    queries = same.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries, queries_path = written(queries, "ann-queries")

    def searched(asked: DataFrame, begin: int, end: int) -> DataFrame:
        """RESULT of queries (query_id, q, bound) in their begin-th to end-th nearest lists, by block."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, QUERY_CHUNK):
                    batch = whole.slice(at, QUERY_CHUNK)
                    to = ordered(unit(_matrix(batch.column(1))) @ turn, centre)[:, begin:end]
                    who = pa.array(np.repeat(np.arange(len(to)), to.shape[1]))
                    yield pa.RecordBatch.from_arrays([*[c.take(who) for c in batch.columns], pa.array(to.ravel(), pa.int32())], [*batch.schema.names, "list"])

        sent = asked.select("query_id", "q", "bound").mapInArrow(spread, f"query_id long, q {kind}, bound double, list int")
        parts = np.ones(len(centre), np.int64)
        for r in sent.groupBy("list").count().collect():  # MAX_LISTS rows at most
            parts[r["list"]] = -(-r["count"] // QUERY_ROWS)
        per_list, per_part = (F.element_at(F.lit(x.tolist()), F.col("list") + 1) for x in (blocks, parts))
        each = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
        sent = sent.select("*", each(per_list).alias("block"), F.pmod(F.xxhash64("query_id"), per_part).cast("int").alias("part"))
        members = index.select("*", F.pmod(F.xxhash64("v"), per_list).cast("int").alias("block"), each(per_part).alias("part"))
        met = ["list", "block", "part"]
        return members.groupBy(*met).cogroup(sent.groupBy(*met)).applyInArrow(block_best, RESULT)

    def block_best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(left) and len(right):
            raw, ids = _matrix(left.column("v")), left.column("ids").combine_chunks()
            sizes = np.asarray(ids.value_lengths(), np.int64)
            starts = np.cumsum(sizes) - sizes
            flat = ids.flatten()
            id_of, n_of = np.asarray(flat.field("vec_id")), np.asarray(flat.field("n"))
            turned = unit(raw) @ turn
            q_ids, q_raw = np.asarray(right.column("query_id").combine_chunks()), _matrix(right.column("q"))
            bounds = np.asarray(right.column("bound").combine_chunks(), np.float64)
            only = np.where(sizes == 1, id_of[starts], np.iinfo(np.int64).min)  # the id of entries with one
            for at in range(0, len(q_ids), QUERY_CHUNK):
                some = slice(at, at + QUERY_CHUNK)
                asked = q_ids[some]

                def alone(rows: np.ndarray, who: np.ndarray) -> np.ndarray:
                    return (only[rows] == asked[who]) & (sizes[rows] == 1)

                who, found, _, _ = scan(unit(q_raw[some]) @ turn, turned, k, bounds[some], alone)
                order = np.argsort(who, kind="stable")
                who, found = who[order], found[order]
                cuts = np.flatnonzero(np.diff(who)) + 1
                for j, places in zip(who[np.concatenate([[0], cuts])] if len(who) else (), np.split(found, cuts)):
                    score = cosine(q_raw[at + j], raw[places])
                    wide = np.repeat(np.arange(len(places)), sizes[places])
                    inner = np.arange(len(wide)) - np.repeat(np.cumsum(sizes[places]) - sizes[places], sizes[places]) + starts[places][wide]
                    other = id_of[inner] != asked[j]
                    inner, wide = inner[other], wide[other]
                    best = kept_of(id_of[inner], n_of[inner], score[wide], k)
                    out[0].append(np.full(len(best), asked[j]))
                    out[1].append(id_of[inner][best])
                    out[2].append(n_of[inner][best])
                    out[3].append(score[wide][best])
        kinds = (np.int64, np.int64, np.int32, np.float64)
        return pa.table({c.split()[0]: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t)) for c, x, t in zip(RESULT.split(", "), out, kinds)})

    def best_of(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def bounded(found: DataFrame) -> DataFrame:
        """Queries with the bound that their results so far give: twice one less the k-th cosine."""
        far = best_of(found).groupBy("query_id").agg(F.sum("n").alias("rows"), F.min("score").alias("least"))
        out = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(far, "query_id", "left")
        known = F.when(F.col("rows") >= k, 2 - 2 * F.col("least") + 1e-9).otherwise(F.lit(float("inf")))
        return out.select("query_id", "q", known.alias("bound"), F.coalesce("rows", F.lit(0)).alias("rows"))

    start = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(float("inf")).alias("bound"))
    home, home_path = written(searched(start, 0, 1), "ann-home")
    paths, found = [home_path], home
    if probes > 1:
        more, path = written(searched(bounded(home), 1, probes), "ann-more")
        paths.append(path)
        found = home.unionByName(more)
    if probes < len(centre):
        short = bounded(found).where(F.col("rows") < k).select("query_id", "q", "bound")
        if not short.isEmpty():
            rest, path = written(searched(short, probes, len(centre)), "ann-rest")
            paths.append(path)
            found = found.unionByName(rest)
    listed_best, _ = written(best_of(found).select("query_id", "vec_id", "n", "score"), "ann-best")
    for path in (*paths, index_path, queries_path):
        dropped(spark, path)
    each_row = listed_best.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_row"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each_row.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
