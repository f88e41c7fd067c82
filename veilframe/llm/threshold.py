"""Exact top-k by the threshold algorithm over sorted per-dimension lists.

Each shard keeps, per dimension, its vectors in order of that component. A query reads the lists from the end that
its own component favours, deeper and deeper, scores every new vector at once, and stops when the sum of the best
values still unread cannot reach its kth score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.llm.blocks import clean_vectors, in_blocks, nearest


def quantise(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda v: F.floor(F.lit(scale) * v).cast("double"))


def _searcher(k: int):
    def search(queries, shard):
        import numpy as np
        import pandas as pd

        out = []
        for d in sorted(set(queries.x.map(len))):
            mine, rows = queries[queries.x.map(len) == d], shard[shard.x.map(len) == d].sort_values("id")
            if not len(rows):
                continue
            x, ids = np.stack(rows.x.to_numpy()), rows.id.to_numpy()
            n = len(x)
            lists = np.argsort(x, axis=0, kind="stable").T  # per dimension, smallest first
            values = np.take_along_axis(x.T, lists, axis=1)
            for qid, w in zip(mine.id.to_numpy(), np.stack(mine.x.to_numpy())):
                dims = np.flatnonzero(w)
                up = w[dims] > 0
                seen = ids == qid
                got, scores = np.empty(0, np.int64), np.empty(0)
                depth, step = 0, 16
                while depth < n:
                    step = min(step, n - depth)
                    block = np.where(up[:, None], lists[dims, n - depth - step:n - depth], lists[dims, depth:depth + step]) if len(dims) else np.arange(n)[None, :]
                    fresh = np.zeros(n, bool)
                    fresh[block.ravel()] = True
                    fresh &= ~seen
                    seen |= fresh
                    new = np.flatnonzero(fresh)
                    got, scores = np.concatenate([got, new]), np.concatenate([scores, x[new] @ w])
                    if len(got) > k:  # keep the kth score and its ties
                        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                        got, scores = got[scores >= kth], scores[scores >= kth]
                    depth += step
                    if seen.all() or not len(dims):
                        break
                    if depth < n and len(got) >= k:
                        unread = np.where(up, values[dims, n - depth - 1], values[dims, depth])
                        if float(unread @ w[dims]) < scores.min():
                            break
                    step *= 2
                if len(got) > k:
                    best = np.lexsort((ids[got], -scores))[:k]
                    got, scores = got[best], scores[best]
                out.append(pd.DataFrame({"query_id": np.full(len(got), qid), "vec_id": ids[got], "score": scores}))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return pd.concat(out)

    return search


def top_k(df: DataFrame, query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each row fulfilling ``query`` (on ``id``).

    Components become floor(scale * x). All candidates, if fewer; ties to the smaller id. Vectors that are null, empty,
    or hold null or non-finite components take no part; a vector meets only those of its own dimension. Rows that
    repeat an id count once (their smallest vector); a row is no candidate of itself. Sums are exact below 2^53.
    """
    vectors = clean_vectors(df, key, vector, nonzero=False).withColumn("x", quantise(F.col("x"), scale))
    found = nearest(in_blocks(vectors, query, _searcher(k)), k)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
