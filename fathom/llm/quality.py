"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of overlapping chunks that cover the whole document; each filter is max-pooled inside its chunk, the chunks' maxima are
combined (their maximum and their mean over the document), and one logistic unit turns them into one probability. Training is plain numpy on the driver, over a bounded
sample of labelled rows; scoring is one map over Arrow batches, with no shuffle, and every byte of every document is read.

Defined cases: a null or empty text is one chunk of padding and gets that chunk's score; a text of any length is cut
into chunks, so memory is bounded by the block of chunks, not by the text; repeated rows get equal scores; an empty table gives
no rows; without labels, or with labels of one class only, every score is the mean label (0.5 without any). Labels that contradict
each other for one doc_id count as the lower one. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_views, dropped, written

CHUNK, OVERLAP, STRIDE, WIDTH = 512, 64, 4, 8
EMBED, FILTERS = 8, 24
BLOCK = 192  # chunks convolved at a time
TRAIN_ROWS = 4096  # labelled rows that training may use, half of each class
TRAIN_BYTES = 32768  # of a labelled text
PIECES = 16  # that a longer text is cut to
EPOCHS, BATCH, RATE = 8, 32, 0.01
LEAST_STEPS = 900  # small samples are gone through more often
THRESHOLD = 0.7


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED, row 0 is padding
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    weight: np.ndarray  # of the maxima, then of the means
    offset: float
    constant: float | None = None


def chunk_starts(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of each chunk, and each document's first chunk."""
    hop = CHUNK - OVERLAP
    count = np.maximum(1, -(-(sizes - OVERLAP) // hop))
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), count)
    step = (np.arange(len(doc)) - first[doc]) * hop
    return starts[doc] + step, np.minimum(CHUNK, sizes[doc] - step), doc, first.astype(np.int64)


def gathered(raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of chunks, padded with 0."""
    place = np.arange(CHUNK)
    inside = place < length[:, None]
    if not len(raw):
        return np.zeros(inside.shape, np.uint8)
    return np.where(inside, raw[np.minimum(at[:, None] + place, len(raw) - 1)], 0).astype(np.uint8)


def convolved(net: Network, x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rectified filter responses, chunk x position x filter; positions that begin in the padding are 0."""
    n, half = len(x), STRIDE * EMBED
    e = net.embed[x].reshape(n * (CHUNK // STRIDE), half)
    both = (e @ np.hstack([net.filters[:half], net.filters[half:]])).reshape(n, CHUNK // STRIDE, 2 * FILTERS)
    z = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:] + net.bias
    np.maximum(z, 0, out=z)
    z *= (np.arange(z.shape[1]) * STRIDE < np.maximum(length, 1)[:, None])[:, :, None]
    return z


def scores(net: Network, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if net.constant is not None:
        return np.full(len(sizes), net.constant)
    if not len(sizes):
        return np.zeros(0)
    at, length, _, first = chunk_starts(starts, sizes)
    top = np.empty((len(at), FILTERS), np.float32)
    for i in range(0, len(at), BLOCK):
        part = slice(i, i + BLOCK)
        top[part] = convolved(net, gathered(raw, at[part], length[part]), length[part]).max(axis=1)
    count = np.diff(np.append(first, len(at)))[:, None]
    pooled = np.hstack([np.maximum.reduceat(top, first, axis=0), np.add.reduceat(top.astype(np.float64), first, axis=0) / count])
    return 1 / (1 + np.exp(-np.clip(pooled @ net.weight.astype(np.float64) + net.offset, -30, 30)))


def train(texts: list[bytes], labels: list[int], prior: float = 0.5, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fits the network by Adam on log loss, classes weighing the same, then moves its offset to the prior share of label 1.

    Deterministic for given rows in a given order.
    """
    y = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        np.full(FILTERS, -0.1, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0,
    )
    net.embed[0] = 0
    if not len(y) or y.min() == y.max():
        net.constant = float(prior) if len(y) else 0.5
        return net
    names, moments, step = ("embed", "filters", "bias", "weight"), {}, 0
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    offset = np.zeros(1, np.float32)
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(y) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs) + 0.001
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            part = [texts[r] for r in rows]
            raw = np.frombuffer(b"".join(part), np.uint8)
            sizes = np.array([len(t) for t in part], np.int64)
            at, length, doc, first = chunk_starts(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            x = gathered(raw, at, length)
            top, place = np.empty((len(at), FILTERS), np.float32), np.empty((len(at), FILTERS), np.int64)
            for j in range(0, len(at), BLOCK):
                z = convolved(net, x[j : j + BLOCK], length[j : j + BLOCK])
                place[j : j + BLOCK] = z.argmax(axis=1)
                top[j : j + BLOCK] = z.max(axis=1)
            count = np.diff(np.append(first, len(at)))[:, None]
            most = np.maximum.reduceat(top, first, axis=0)
            pooled = np.hstack([most, np.add.reduceat(top, first, axis=0) / count])
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.weight + offset, -30, 30)))
            slope = ((p - y[rows]) * share[rows] / len(rows)).astype(np.float32)
            back = slope[:, None] * net.weight
            carriers = top == most[doc]  # chunks that hold the document's maximum share its slope
            held = np.add.reduceat(carriers.astype(np.float32), first, axis=0)
            to_chunk = (back[doc, :FILTERS] * carriers / held[doc] + back[doc, FILTERS:] / count[doc]) * (top > 0)
            spots = place[:, :, None] * STRIDE + np.arange(WIDTH)
            bytes_at = x[np.arange(len(x))[:, None, None], spots]
            seen = net.embed[bytes_at].reshape(len(x), FILTERS, WIDTH * EMBED)
            into = (to_chunk[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            grads = {
                "weight": pooled.T @ slope + 1e-4 * net.weight, "filters": np.einsum("nf,nfk->kf", to_chunk, seen), "bias": to_chunk.sum(axis=0),
                "embed": np.stack([np.bincount(bytes_at.ravel(), into[:, k], 256) for k in range(EMBED)], axis=1), "offset": slope.sum(keepdims=True),
            }
            grads["embed"][0] = 0
            step += 1
            for name, g in grads.items():
                m, v = moments.get(name, (0, 0))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[name] = m, v
                change = (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if name == "offset":
                    offset -= change
                else:
                    getattr(net, name).__isub__(change)
    assert all(np.isfinite(getattr(net, k)).all() for k in names)
    prior = min(max(prior, 0.01), 0.99)
    net.offset = float(offset[0]) + float(np.log(prior / (1 - prior)))
    return net


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> tuple[list[bytes], list[int], float]:
    """At most `rows` labelled texts, half of each class, the first by a hash of doc_id, and the share of label 1; held-out ids never.

    Of a text over TRAIN_BYTES, as many bytes in PIECES pieces, spread evenly from its start to its end.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    known, path = written(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "known-labels")
    prior = known.agg(F.avg("y")).first()[0]
    first = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for c in (0, 1)]
    spark, chosen = docs.sparkSession, [(r["doc_id"], r["y"]) for df in first for r in df.collect()]
    dropped(spark, path)
    if not chosen:
        return [], [], 0.5
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, y int"))  # TRAIN_ROWS rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size, piece = F.octet_length("text").cast("long"), TRAIN_BYTES // PIECES
    pieces = F.concat(*[F.substring("text", ((size - piece) * i / (PIECES - 1)).cast("int") + 1, F.lit(piece)) for i in range(PIECES)])
    cut = F.when(size <= TRAIN_BYTES, F.col("text")).otherwise(pieces)
    found = texts.join(picked, "doc_id").select("doc_id", "y", cut.alias("text")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = sorted((r["doc_id"], r["y"], bytes(r["text"])) for r in found.collect())
    return [t for _, _, t in sample], [y for _, y, _ in sample], prior


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        for batch in batches:
            raw, starts, sizes = byte_views(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(net, raw, starts, sizes), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.7)."""
    net = train(*training_rows(docs, labels))
    return scored(docs, net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least 0.7."""
    net = train(*training_rows(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            yield batch.filter(pa.array(scores(net, *byte_views(column)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
