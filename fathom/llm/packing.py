"""Packing by vector bin packing.

An example is a vector: its tokens, its segments (one) and its loss-bearing tokens. A sequence is a bin with a limit on each. Bins are filled one at
a time: of the waiting examples that still fit, the one whose vector has the largest dot product with the bin's remaining capacity (both as shares of
the limits) goes in, until none fits. Where examples may be cut (documents; not instruction examples), what is longer than a sequence is cut into
full sequences first, a bin in which nothing fits is filled by the head of the largest waiting example, and a bin that stays short (the last of
a task) is cut into lengths that are powers of two, which are not padded. Where they may not be cut, an example over a limit fits no sequence: it is given whole, as
one piece without a sequence (null sequence_id, offset and segment), so that no row is lost and none stops the job.

Each task packs the rows it reads, POOL examples at a time, carrying what waits to the next pool: no shuffle, memory bounded by the pool and one document. Sequence
ids hold the task's number above 33 bits, so they are unique and the same when a lost task runs again over the same files.

Token ids are those of the tokenizer's JSON file. The ranks file of the same vocabulary, if given, gives the same ids several times faster;
texts that hold a special token's string go through the JSON file's tokenizer.

Defined cases: a null or empty text is its end id alone; a text of any length is cut; repeated rows are packed as often as they come; an empty table gives no rows;
a document's last token's loss counts like any other, and the first id of a piece bears no loss, as nothing precedes it. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, SEGMENTS, END = 1024, 256, 0
POOL = 1024
OUT_ROWS = 2000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = LENGTH
    segments: int = SEGMENTS
    loss: int = LENGTH


@lru_cache(maxsize=4)
def tokenizer(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[str], np.ndarray]:
    """Text to uint32 ids. json_path: a tokenizer's file; ranks_path, pattern: the same vocabulary as ranks and its splitting pattern."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def plain(text: str) -> np.ndarray:
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    if not ranks_path:
        return plain
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def quick(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return plain(text)
        try:
            return np.asarray(fast.encode_ordinary(text), np.uint32)
        except Exception:  # its regular expression engine gives up on some very long runs
            return plain(text)

    return quick


def public(name: str = "byte_bpe_50k") -> Callable[[str], np.ndarray]:
    import public_tokenizers as p

    return tokenizer(p.path(f"{name}.json"), p.path(f"{name}.tiktoken"), p.PATTERN)


def fill(sizes: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Bins of (example, first token, tokens), and what waits for the next pool (same form). loss: an example's loss-bearing tokens, without cutting. No example
    may exceed a limit unless it may be cut.

    Without `last`, packing stops as soon as the waiting tokens fill less than four bins.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    begin, left, free = np.zeros(len(sizes), np.int64), sizes.astype(np.int64).copy(), loss.astype(np.int64).copy()
    bins: list[list[tuple[int, int, int]]] = []
    if cut:
        for i in np.flatnonzero(left > limits.tokens):
            while left[i] > limits.tokens:
                bins.append([(int(i), int(begin[i]), limits.tokens)])
                begin[i] += limits.tokens
                left[i] -= limits.tokens
            free[i] = max(0, left[i] - 1)
    alive = np.flatnonzero(left > 0)
    total = int(left.sum())
    while len(alive) and (last or total >= 4 * limits.tokens):
        room, held = cap.copy(), []
        while len(alive) and room[0] > 0 and room[1] > 0:
            size, bears = left[alive], free[alive]
            fits = (size <= room[0]) & (bears <= room[2])
            if fits.any():
                value = (size / cap[0]) * (room[0] / cap[0]) + (room[1] / cap[1]) / cap[1] + (bears / cap[2]) * (room[2] / cap[2])
                at = int(np.where(fits, value, -1).argmax())
                i = int(alive[at])
                held.append((i, int(begin[i]), int(left[i])))
                room -= (left[i], 1, free[i])
                total -= int(left[i])
                alive = np.delete(alive, at)
            elif cut and min(room[0], room[2]) >= 1:
                at = int(size.argmax())
                i, n = int(alive[at]), int(min(room[0], room[2], size[at]))
                held.append((i, int(begin[i]), n))
                begin[i] += n
                left[i] -= n
                free[i] = max(0, left[i] - 1)
                total -= n
                room -= (n, 1, n - 1)
                if not left[i]:
                    alive = np.delete(alive, at)
            else:
                break
        if not held:
            i = int(alive[0])
            raise ValueError(f"an example of {left[i]} tokens, {free[i]} of them loss-bearing, exceeds the limits {limits}")
        bins.append(held)
    if cut:
        bins = [part for held in bins for part in halved(held, limits.tokens)]
    return bins, [(int(i), int(begin[i]), int(left[i])) for i in alive]


def halved(held: list[tuple[int, int, int]], full: int) -> list[list[tuple[int, int, int]]]:
    """A bin that is not full, cut into bins whose lengths are powers of two, which need no padding."""
    total = sum(n for *_, n in held)
    if total == full:
        return [held]
    out, waiting = [], held[::-1]
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        part = []
        while want:
            i, first, n = waiting.pop()
            take = min(n, want)
            part.append((i, first, take))
            want -= take
            if take < n:
                waiting.append((i, first + take, n - take))
        out.append(part)
    return out


def packed(
    docs: DataFrame,
    encode: Callable[[], Callable[[str], np.ndarray]] = public,
    limits: Limits = Limits(),
    cut: bool = True,
    end: int | None = END,
    prompt_tokens: str | None = None,
) -> DataFrame:
    """One row per piece (SCHEMA): ids are its token ids, little-endian unsigned 32-bit; start counts its document's ids before it, offset the sequence's.

    cut=False keeps examples whole, for instruction data, and those over a limit out of all sequences; prompt_tokens names a column with the number of leading tokens that bear no loss.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    columns.append(F.coalesce(F.col(prompt_tokens).cast("int"), F.lit(0)).alias("prompt") if prompt_tokens else F.lit(0).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        tokens, pool, out = encode(), [], []  # pool: doc_id, all its ids, first id that waits, ids that wait, loss-bearing ones of them
        tail = np.array([] if end is None else [end], "<u4")

        def place(last: bool) -> None:
            nonlocal pool, sequence
            bins, rest = fill(np.array([x[3] for x in pool], np.int64), np.array([x[4] for x in pool], np.int64), limits, cut, last)
            for held in bins:
                offset = 0
                for k, (i, first, n) in enumerate(held):
                    doc, ids, begin, _, _ = pool[i]
                    at = begin + first
                    whole = not first and n == pool[i][3]
                    out.append((doc, at, n, ids[at : at + n].tobytes(), len(ids), sequence, offset, k, pool[i][4] if whole else max(0, n - 1)))
                    offset += n
                sequence += 1
            pool = [(pool[i][0], pool[i][1], pool[i][2] + first, n, pool[i][4] if not first else max(0, n - 1)) for i, first, n in rest]

        def drained(least: int) -> Iterator[pa.RecordBatch]:
            while len(out) >= max(1, least):
                part, out[:] = out[:OUT_ROWS], out[OUT_ROWS:]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names)

        waiting = 0
        for batch in batches:
            for k in range(batch.num_rows):
                doc, text, prompt = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                ids = np.concatenate([tokens(text).astype("<u4"), tail])
                loss = max(0, len(ids) - max(1, prompt))
                if not cut and (len(ids) > limits.tokens or loss > limits.loss):
                    out.append((doc, 0, len(ids), ids.tobytes(), len(ids), None, None, None, loss))
                elif len(ids):
                    pool.append((doc, ids, 0, len(ids), loss))
                    waiting += len(ids)
                if len(pool) >= POOL or waiting >= POOL * limits.tokens:
                    place(False)
                    waiting = sum(x[3] for x in pool)
                    yield from drained(OUT_ROWS)
        if pool:
            place(True)
        yield from drained(1)

    return docs.select(*columns).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("segment"), "loss_tokens"
    )
