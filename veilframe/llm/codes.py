"""Compressed vector codes (product quantisation) whose nearest entries are found by Orchard's search.

Every codebook keeps, for each entry, all entries in order of their distance from it. A vector part starts at one entry
and walks the list of the best entry so far; on an improvement it jumps to the improved entry's list; entries already
compared are marked; the walk ends when the next entry lies beyond twice the current distance, since by the triangle
inequality neither it nor any later one can be nearer or equally near. All numbers are integers, so results are exact.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of
another dimension than the row of smallest id; an empty table gives an empty result; null and repeated ids are coded
like others, null ids start no entry; with fewer rows than entries the codebook is as small as the table; the dimension
must be a multiple of the number of parts and components below 2**20, otherwise the job fails with that message; extra
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from veilframe.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BATCH = 4096


@dataclass
class Codebook:
    """Entries of every part, (parts, entries, width) integers."""

    entries: np.ndarray

    def __post_init__(self):
        gap = self.entries[:, :, None, :] - self.entries[:, None, :, :]
        self.between = (gap * gap).sum(-1)  # squared distances of entries
        self.near = np.argsort(self.between, axis=2, kind="stable")  # every entry's list, itself first
        mean = self.entries.mean(1, keepdims=True)
        self.start = ((self.entries - mean) ** 2).sum(-1).argmin(1)  # the most central entry of each part

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of x; ties go to the lower entry. Orchard's search, a batch at a time."""
        book, between, near = self.entries[part], self.between[part], self.near[part]
        n, k = len(x), len(book)
        best = np.full(n, self.start[part])
        diff = x - book[best]
        dist = (diff * diff).sum(1)
        marked = np.zeros((n, k), bool)
        marked[np.arange(n), best] = True
        place = np.ones(n, np.int64)  # place 0 of a list is its own entry, or one that ties with it
        place[near[best, 0] != best] = 0
        open_ = np.arange(n) if k > 1 else np.arange(0)
        while len(open_):
            at = best[open_]
            candidate = near[at, place[open_]]
            alive = between[at, candidate] <= 4 * dist[open_]  # distance not beyond twice the current one, squared
            open_, candidate = open_[alive], candidate[alive]
            place[open_] += 1
            fresh = ~marked[open_, candidate]
            rows, c = open_[fresh], candidate[fresh]
            marked[rows, c] = True
            diff = x[rows] - book[c]
            d = (diff * diff).sum(1)
            better = (d < dist[rows]) | ((d == dist[rows]) & (c < best[rows]))
            rows, c, d = rows[better], c[better], d[better]
            best[rows], dist[rows], place[rows] = c, d, 0
            open_ = open_[place[open_] < k]
        return best, dist

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), both (rows, parts)."""
        parts = len(self.entries)
        cut = x.reshape(len(x), parts, -1)
        pairs = [self.nearest(p, cut[:, p]) for p in range(parts)]
        return np.stack([c for c, _ in pairs], 1), np.stack([d for _, d in pairs], 1)


def integers(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows with a usable vector, as ``x``: floor(scale * component)."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.forall(v, lambda c: F.abs(c) < 1 << 20)
    wide = F.raise_error(F.lit("vector components must stay below 2**20")).cast("array<bigint>")
    return df.filter(good).withColumn("x", F.when(small, F.transform(v, lambda c: F.floor(c * scale).cast("bigint"))).otherwise(wide))


def batches(records):
    """Record batches of a partition in slices of bounded size, with their vectors as an integer array."""
    for batch in records:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)


def fit(vectors: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebook | None:
    """Codebook from the vectors of the smallest ids, moved ``rounds`` times to the floor of its parts' means.

    The driver sees the codebook and its sums only: ``parts`` x ``entries`` rows a round.
    """
    seeds = vectors.filter(F.col(key).isNotNull()).orderBy(key, "x").limit(entries).select("x").collect()
    if not seeds:
        return None
    start = np.array([r["x"] for r in seeds], np.int64)
    width = start.shape[1] // parts
    book = Codebook(start.reshape(len(start), parts, width).transpose(1, 0, 2).copy())
    held = vectors.sparkSession.sparkContext.broadcast
    for _ in range(rounds):
        shared = held(book)

        def sums(records):
            import pyarrow as pa

            book = shared.value
            p, k, w = book.entries.shape
            total, count = np.zeros((p, k, w), np.int64), np.zeros((p, k), np.int64)
            for _, x in batches(records):
                codes, _ = book.assign(x)
                cut = x.reshape(len(x), p, w)
                for part in range(p):
                    np.add.at(total[part], codes[:, part], cut[:, part])
                    count[part] += np.bincount(codes[:, part], minlength=k)
            for part in range(p):
                used = np.flatnonzero(count[part])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(used), part), pa.int32()), "entry": pa.array(used, pa.int32()),
                    "n": pa.array(count[part][used], pa.int64()), "total": pa.array(total[part][used].tolist(), pa.list_(pa.int64()))})

        added = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
        moved = vectors.select("x").mapInArrow(sums, "part int, entry int, n bigint, total array<bigint>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *added)
        new = book.entries.copy()
        for r in moved.collect():
            new[r["part"], r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
        book = Codebook(new)
    return book


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebook | None]:
    """((key, group, code, error) of every usable vector, codebook); a code has two hex digits a part."""
    vectors = integers(df.select(F.col(key), F.col(vector), F.col(group).alias("__group")), vector).select(F.col(key).alias("id"), F.col("__group"), "x")
    first = vectors.filter("id is not null").orderBy("id", "x").select(F.size("x")).first() or vectors.select(F.size("x")).orderBy(F.size("x")).first()
    shape = f"id {vectors.schema['id'].dataType.simpleString()}, __group {vectors.schema['__group'].dataType.simpleString()}, code string, error bigint"
    if first and first[0] % parts:
        raise ValueError(f"vectors of {first[0]} components cannot be cut into {parts} equal parts")
    vectors = materialize(vectors.filter(F.size("x") == (first[0] if first else 0)), "vectors")
    book = fit(vectors, "id", parts, entries, rounds)
    if book is None:  # no row, or no row with an id to start from
        return vectors.limit(0).select(F.col("id").alias(key), F.col("__group").alias(group), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), None
    shared = df.sparkSession.sparkContext.broadcast(book)

    def encode(records):
        import pyarrow as pa

        for part, x in batches(records):
            codes, far = shared.value.assign(x)
            text = codes.astype(np.uint8).tobytes().hex()
            w = 2 * codes.shape[1]
            code = pa.array([text[i:i + w] for i in range(0, len(text), w)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("__group"), code, pa.array(far.sum(1))], ["id", "__group", "code", "error"])

    return vectors.mapInArrow(encode, shape).withColumnsRenamed({"id": key, "__group": group}), book


def with_group_error(coded: DataFrame, group: str = "label") -> DataFrame:
    """Adds ``<group>_error``: errors summed over rows of an equal group, nulls together.

    Sums are joined back; a small table of groups is broadcast by size, a large one is shuffled and hot groups are split.
    """
    coded = materialize(coded, "codes")
    sums = materialize(coded.groupBy(F.col(group).alias("__g")).agg(F.sum("error").alias(f"{group}_error")), "errors")
    return coded.join(sums, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
