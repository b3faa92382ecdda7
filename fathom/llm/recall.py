"""Recall of op10_neighbours against brute force: python -m fathom.llm.recall FOLDER... (each with embeddings.parquet). Brute force runs in memory, on small tables."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fathom.llm import ann


def exact(vectors: pd.DataFrame, every: int = ann.EVERY, k: int = ann.K) -> dict[int, list[tuple[int, float]]]:
    """For each query the k nearest (vec_id, cosine) of all other rows. vectors: vec_id, embedding, all valid; a query's vector is its smallest."""
    ids = vectors.vec_id.to_numpy(np.int64)
    x = np.stack(vectors.embedding.to_numpy()).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.unique(ids[ids % every == 0]):
        own = min(np.flatnonzero(ids == q), key=lambda i: tuple(x[i]))
        score = u @ u[own]
        rest = np.flatnonzero(ids != q)
        best = rest[np.lexsort((ids[rest], -np.round(score[rest], 12)))[:k]]
        out[int(q)] = [(int(ids[i]), float(score[i])) for i in best]
    return out


def recall(vectors: DataFrame, **settings) -> float:
    """Share of the true neighbours that are found, where one of an equal cosine counts as well."""
    want = exact(vectors.select("vec_id", "embedding").toPandas())
    found: dict[int, list[float]] = {}
    for r in ann.neighbours(vectors, **settings).collect():
        found.setdefault(r.query_id, []).append(r.score)
    hit = sum(sum(s >= w[-1][1] - 1e-9 for s in found.get(q, [])) for q, w in want.items() if w)
    return hit / max(1, sum(len(w) for w in want.values()))


def main() -> None:
    from fathom.session import session

    spark = session("recall", spark__master="local[8]", spark__driver__memory="6g", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    for folder in sys.argv[1:]:
        vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
        print(folder, vectors.count(), round(recall(vectors), 4))
    spark.stop()


if __name__ == "__main__":
    main()
