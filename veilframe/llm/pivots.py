"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. In each shard it is posted, with its place in that order, in
the inverted files of those pivots. A query walks the files of its own nearest pivots, which gives the footrule
distance (sum of place differences, a missing pivot counting as one past the end) to every posted vector; the
nearest by footrule are ranked again by exact inner product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.llm.blocks import clean_vectors, in_blocks, nearest
from veilframe.llm.common import bounded_sample

#: Pivots drawn (bound of the fitted sample), pivots kept per vector, share and least number of a shard's vectors ranked again.
PIVOTS, LENGTH, SHARE, LEAST = 192, 24, 0.4, 512


def choose_pivots(vectors: DataFrame, n: int = PIVOTS):
    """At most about ``n`` pivots, drawn by a hash of the id: distinct directions among a bounded sample."""
    import numpy as np

    rows = sorted((r["id"], r["x"]) for r in bounded_sample(vectors, "id", n).collect())
    sizes = [len(x) for _, x in rows]
    if not sizes:
        return np.zeros((0, 0))
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    p = np.array([x for _, x in rows if len(x) == d])
    return np.unique(p / np.linalg.norm(p, axis=1, keepdims=True), axis=0)


def permutations(x, pivots, length: int):
    """Numbers of the ``length`` nearest pivots of each vector, nearest first."""
    import numpy as np

    near = x @ pivots.T
    part = np.argpartition(-near, length - 1, axis=1)[:, :length]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, axis=1), axis=1, kind="stable"), axis=1)


def _searcher(pivots, k: int, length: int, share: float, least: int):
    def search(queries, shard):
        import numpy as np
        import pandas as pd

        shape = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        d = pivots.shape[1] if len(pivots) else -1
        queries, shard = queries[queries.x.map(len) == d], shard[shard.x.map(len) == d].sort_values("id")
        if not len(queries) or not len(shard):
            return shape
        x, ids = np.stack(shard.x.to_numpy()), shard.id.to_numpy()
        q, qids = np.stack(queries.x.to_numpy()), queries.id.to_numpy()
        m = min(length, len(pivots))
        own, asked = permutations(x, pivots, m), permutations(q, pivots, m)
        order = np.argsort(own.ravel(), kind="stable")
        posted, place = (order // m).astype(np.int32), (order % m).astype(np.int16)
        files = np.searchsorted(own.ravel()[order], np.arange(len(pivots) + 1))
        out = []
        want = min(len(x), max(least, k + 1, int(share * len(x))))
        for row, qid, list_ in zip(q, qids, asked):
            distance = np.zeros(len(x), np.int32)  # minus what shared pivots save against "missing"
            for at, pivot in enumerate(list_):
                a, b = files[pivot], files[pivot + 1]
                distance[posted[a:b]] -= (2 * m - at - place[a:b]) - np.abs(place[a:b] - at)
            near = np.argpartition(distance, want - 1)[:want] if want < len(x) else np.arange(len(x))
            near = near[ids[near] != qid]
            score = (x[near] * row).sum(axis=1) if len(near) < 64 else x[near] @ row
            if len(near) > k:
                kth = np.partition(score, len(score) - k)[len(score) - k]
                close = score >= kth - 1e-9
                near, score = near[close], score[close]
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[near], "score": score}))
        return pd.concat(out) if out else shape

    return search


def search(df: DataFrame, query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, length: int = LENGTH, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row fulfilling ``query`` (on ``id``).

    Scores are exact inner products in double precision, summed in component order. Fewer than k candidates: all.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another
    dimension than most. Rows that repeat an id count once (their smallest vector); a row is no candidate of itself.
    """
    vectors = clean_vectors(df, key, vector, nonzero=True)
    drawn = choose_pivots(vectors, pivots)
    found = in_blocks(vectors, query, _searcher(drawn, k, length, share, least))
    best = nearest(found, 2 * k)
    exact = F.aggregate(F.zip_with("a.x", "b.x", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    a, b = vectors.select(F.col("id").alias("query_id"), "x").alias("a"), vectors.select(F.col("id").alias("vec_id"), "x").alias("b")
    again = best.select("query_id", "vec_id").join(a, "query_id").join(b, "vec_id").select("query_id", "vec_id", exact.alias("score"))
    return nearest(again, k).select("query_id", "rank", "vec_id", "score")
