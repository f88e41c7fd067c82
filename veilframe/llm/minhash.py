"""Near-duplicate classes: one-permutation MinHash with optimal densification, banded buckets, star edges.

Plan: one scan turns each text into a set size, a 128-bit fingerprint of its shingle set, 48 band keys, a 256-bit
sketch and a 1024-bit parity map. Equal sets collapse by fingerprint, so copies cost one row. Each bucket links its
members to one hub only (a star), so a bucket of m texts gives m - 1 candidate pairs. Candidates pass a size, map and
sketch test and are then confirmed on full shingle sets. Members of a bucket that end in different classes are compared
with that bucket's smaller classes, so a star never hides a link between different texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veilframe.session import materialize

BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Sets of at least this size are compared by sketch first; of 256 bits, equal sets share all, sets at 0.8 about 230 +- 5.
SKETCHED, AGREE = 100, 196
#: 64-bit words of the parity map: each shingle flips one bit, so two maps differ in at most as many bits as the sets in shingles.
MAP_WORDS = 16
SKETCH = [*(f"s{i}" for i in range(4)), *(f"p{i}" for i in range(MAP_WORDS))]
SIGNATURE = "n long, fp binary, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)


class _WordHash(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _WordHash()


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = 2):
    """Sorted distinct 64-bit shingle hashes of a UTF-8 text."""
    import numpy as np

    words = text.lower().split() if text else []  # on bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i])
    return np.unique(out)


_DONORS: list = []


def _donors():
    """Bins that an empty bin asks in turn: the same order for every text."""
    import numpy as np

    if not _DONORS:
        _DONORS.append(np.random.default_rng(20).integers(0, BINS, (4096, BINS)))
    return _DONORS[0]


def one_permutation(hashes):
    """Smallest hash of each of the equal ranges of the hash space; an empty range takes that of a random full one."""
    import numpy as np

    low = (np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS))
    at = np.searchsorted(hashes, low)
    full = np.append(at[1:], len(hashes)) > at
    values = hashes[np.minimum(at, len(hashes) - 1)]
    if full.all():
        return values
    source, empty, step, size = np.arange(BINS), np.flatnonzero(~full), 0, 8
    order = _donors()
    while len(empty) and step < len(order):
        ask = order[step:step + size][:, empty]
        ok = full[ask]
        hit = ok.any(axis=0)
        source[empty[hit]] = ask[ok.argmax(axis=0)[hit], np.flatnonzero(hit)]
        empty, step, size = empty[~hit], step + size, size * 4
    if len(empty):  # the list of donors ran out: the first full bin
        source[empty] = np.flatnonzero(full)[0]
    return values[source]


def _signature(hashes):
    import numpy as np
    import xxhash

    fp = xxhash.xxh128_digest(hashes.tobytes())
    if not len(hashes):
        return 0, fp, [], *[0] * len(SKETCH)
    values = one_permutation(hashes)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + values[i::ROWS])
    bits = np.packbits((_mix(values[:256]) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    flips = np.bincount((hashes % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    parity = np.packbits(flips.astype(np.uint8)).view(np.int64)
    return len(hashes), fp, key.view(np.int64), *bits.tolist(), *parity.tolist()


def _signatures(width: int):
    @F.arrow_udf(SIGNATURE)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [_signature(shingle_set(t.as_py(), width)) for t in batch]
            n, fp, bands, *bits = zip(*rows) if rows else [()] * (3 + len(SKETCH))
            fields = [pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(b, pa.int64()) for b in bits)]
            yield pa.StructArray.from_arrays(fields, ["n", "fp", "bands", *SKETCH])

    return sign


def _sets(width: int):
    @F.arrow_udf("struct<fp binary, hashes array<long>>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import xxhash

        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch]
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), lists], ["fp", "hashes"])

    return shingles.asNondeterministic()  # else the optimiser makes it a join key and runs it over all texts


def _differing(names: list[str]) -> Column:
    """Bits in which the two sides differ."""
    return reduce(add, (F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in names))


def _alike(percent: int) -> Column:
    """Size, parity map and sketch test of a candidate pair; no pair at or above the threshold fails the first two.

    100 * |A n B| >= percent * |A u B| says that at most (100 - percent) / (100 + percent) of |A| + |B| shingles are in
    one set only, and the maps differ in no more bits than that.
    """
    small = F.least("a.n", "b.n")
    sized = 100 * small >= percent * F.greatest("a.n", "b.n")
    near = (100 + percent) * _differing(SKETCH[4:]) <= (100 - percent) * (F.col("a.n") + F.col("b.n"))
    return sized & near & ((small < SKETCHED) | (256 - _differing(SKETCH[:4]) >= AGREE))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of an edge table (a, b): the smallest node of each component.

    Smallest neighbour plus pointer jumping, so long chains take logarithmically many rounds; each round is
    written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        new = materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("to"))
        new = materialize(new.join(jump, "label", "left").select("node", "old", F.least("label", "to").alias("label")), "labels")
        done = new.filter("label <> old").isEmpty()
        labels = new.select("node", "label")
        if done:
            return labels


def _confirm(pairs: DataFrame, docs: DataFrame, rows: DataFrame, key: str, text: str, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) of fingerprints whose full sets reach the threshold. Only texts of candidates are read again."""
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    one = rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(key).alias("__key"), F.min("n").alias("n"))
    texts = docs.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text"))
    got = texts.join(one, "__key").withColumn("__s", _sets(width)("__text")).filter("__s.fp = fp").select("fp", "n", F.col("__s.hashes").alias("h"))
    # texts that only rows without a key have are found by their sets
    bare = texts.filter("__key is null").withColumn("__s", _sets(width)("__text")).select(F.col("__s.fp").alias("fp"), F.col("__s.hashes").alias("h"))
    got = got.unionByName(bare.join(one.filter("__key is null").select("fp", "n"), "fp").select("fp", "n", "h"))
    sets = materialize(got, "sets").dropDuplicates(["fp"])
    left, right = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha")), sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (smallest key reachable), kept (is that key).

    Two texts are linked when ``100 * |A n B| >= percent * |A u B|`` for their sets of ``width``-word shingles; a
    text with fewer words is one shingle. A null, empty or blank text has size 0 and is linked with nothing. Rows
    that repeat a key are judged each for itself, and the key stands for them; rows with a null key are compared like
    others, but a null key is never another row's component unless all keys of a component are null, and then all of its
    rows are kept: number the rows where keys are null or repeat. Other columns are not read.
    """
    slim = docs.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text"))
    signed = slim.withColumn("__s", _signatures(width)("__text")).select("__key", "__s.*")
    rows = materialize(signed, "signatures")
    sets = materialize(
        rows.filter("n > 0").groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "bands", *SKETCH))), "distinct")
    posted = sets.select(F.explode("bands").alias("bucket"), "fp")
    sizes = materialize(posted.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    members = materialize(posted.join(sizes, "bucket"), "members")
    degree = materialize(members.groupBy("fp").agg(F.sum("m").alias("degree")), "degree")
    central = members.select("bucket", "fp").join(degree, "fp").groupBy("bucket").agg(F.max(F.struct("degree", "fp")).alias("hub"))
    members = members.select("bucket", "fp")
    hubs = materialize(central.select("bucket", F.col("hub.fp").alias("hub")), "hubs")
    sketch = sets.drop("bands")
    star = members.join(hubs, "bucket").filter("fp <> hub").select(F.col("hub").alias("x"), F.col("fp").alias("y")).distinct()
    star = star.join(sketch.alias("a"), F.col("x") == F.col("a.fp")).join(sketch.alias("b"), F.col("y") == F.col("b.fp")).filter(_alike(percent))
    star = materialize(star.select(F.col("x").alias("a"), F.col("y").alias("b")), "star")
    keyed = rows.withColumnRenamed("__key", key)
    edges = materialize(_confirm(star, docs, keyed, key, text, percent, width), "links")

    classes = components(edges)
    labelled = members.select("bucket", "fp").join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    shares = labelled.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    split = shares.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("main"), F.count("*").alias("k")).filter("k > 1").select("bucket", F.col("main.label").alias("main"))
    open_ = materialize(labelled.join(split, "bucket").join(sketch, "fp"), "open")
    a, b = open_.filter("label <> main").alias("a"), open_.alias("b")
    once = (F.col("b.label") == F.col("b.main")) | (F.col("a.fp") < F.col("b.fp"))  # of two smaller classes, from one side
    rest = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.label") != F.col("b.label")) & once & _alike(percent))
    rest = rest.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()
    rest = materialize(rest.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    more = materialize(_confirm(rest, docs, keyed, key, text, percent, width), "links")
    if not more.isEmpty():
        classes = components(edges.union(more))

    owner = rows.filter("n > 0").groupBy("fp").agg(F.min("__key").alias("root"))
    owner = owner.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = owner.groupBy("label").agg(F.min("root").alias("component_id"))
    place = owner.join(lowest, "label").select("fp", "component_id")
    out = rows.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), "fp").join(place, "fp", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", key))
    return out.select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))
