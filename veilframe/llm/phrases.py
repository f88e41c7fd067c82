"""Phrase collocations: frequent phrases by Rabin-Karp fingerprints, scored by their weakest cut.

1. Texts become blocks of words of one language (a table of its own: vocabulary and word numbers).
2. Each block hashes every n-gram with prefix polynomials and sends each distinct fingerprint once, with its count and
   the block that holds it, to the shard of its leading bits. A shard adds the counts up; every shard is of bounded size
   and a fingerprint reaches it once per block, however common the phrase.
3. Fingerprints that may be frequent go back to the blocks they point to. There the words themselves are compared,
   phrases are written out and counted exactly, as text. Nothing rare is ever written out.

A collision of fingerprints can only let a rare phrase through to step 3, where texts decide.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows and ids count like any
other row; an empty table gives an empty result; a text longer than a block is cut between pieces, which no phrase
crosses; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilframe.session import materialize

LONGEST, LEAST, TOP, COVER = 4, 30, 2000, 80
#: Bytes of text in a block, n-grams in a shard (about), fewest shards.
BLOCK, SHARD, SHARDS = 4_000_000, 4_000_000, 1024
#: Capitals become small, ends of pieces a line end, tabs a blank.
MAP = bytes(b | 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
BASE = 0x9E3779B97F4A7C15 | 1
END = 0  # number of the end of a piece


def blocks_of(texts):
    """Runs of ``BLOCK`` bytes or more of cleaned text, cut at ends of pieces only."""
    held, size = [], 0
    for text in texts:
        text = text.translate(MAP)
        at = 0
        while len(text) - at > BLOCK:
            cut = text.find(b"\n", at + BLOCK)
            if cut < 0:
                break
            held.append(text[at:cut])
            yield b"\n".join(held)
            held, size, at = [], 0, cut + 1
        held.append(text[at:] if at else text)
        size += len(text) - at
        if size >= BLOCK:
            yield b"\n".join(held)
            held, size = [], 0
    if size:
        yield b"\n".join(held)


def number_words(block: bytes) -> tuple[list[bytes], np.ndarray]:
    """(vocabulary, word numbers) of a block; number 0 ends a piece and is no word."""
    numbers = {b"\n": END, b"": -1}
    found = np.fromiter((numbers.setdefault(w, len(numbers) - 1) for w in block.replace(b"\n", b" \n ").split(b" ")), np.int32)
    words = list(numbers)
    return [b"", *words[2:]], found[found >= 0]


class Fingerprints:
    """Fingerprints of all n-grams of a block from prefix sums of its word hashes times powers of the base (mod 2**64)."""

    def __init__(self, words: list[bytes], numbers: np.ndarray, lang: str):
        import xxhash

        seed = xxhash.xxh64_intdigest(lang.encode())
        hashes = np.array([xxhash.xxh64_intdigest(w, seed=seed) for w in words], np.uint64)
        n = len(numbers)
        inverse = pow(BASE, -1, 1 << 64)
        self.powers = self._powers(BASE, n + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[numbers] * self._powers(inverse, n), dtype=np.uint64)])
        self.ends = np.concatenate([[0], np.cumsum(numbers == END)])
        self.numbers = numbers

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, fingerprint) of every n-gram inside a piece."""
        count = len(self.numbers) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start = np.flatnonzero(self.ends[n:n + count] == self.ends[:count])
        fp = (self.prefix[start + n] - self.prefix[start]) * self.powers[start + n - 1] + np.uint64(n)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
            fp = (fp ^ (fp >> np.uint64(shift))) * np.uint64(factor)
        return start, fp ^ (fp >> np.uint64(32))


def short(fp: np.ndarray, shards: int) -> np.ndarray:
    """Shard in the upper, 32 further bits in the lower half of a number."""
    return ((fp >> np.uint64(32)) % np.uint64(shards) << np.uint64(32)) | (fp & np.uint64(0xFFFFFFFF))


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, byte planes apart (the upper ones are nearly zero), then capped counts."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts.astype(np.uint8).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 5
    planes = np.frombuffer(data, np.uint8)
    steps = np.ascontiguousarray(planes[:4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32), planes[4 * n:]


def word_blocks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(block, lang, n_words, words joined by blanks, numbers), written once: ids of blocks are fixed by that."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("text")).filter("length(text) > 0")

    def build(records):
        import pyarrow as pa

        def table(lang, block):
            words, numbers = number_words(block)
            return pa.RecordBatch.from_pydict({
                "lang": [lang], "n_words": pa.array([int((numbers != END).sum())], pa.int64()),
                "words": pa.array([b" ".join(words)], pa.binary()), "numbers": pa.array([numbers.tobytes()], pa.binary())})

        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in records:
            for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text")):
                data = value.as_py()
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                if sizes[lang] >= BLOCK:
                    yield from (table(lang, b) for b in blocks_of(held.pop(lang)))
                    sizes.pop(lang)
                elif sum(sizes.values()) >= 2 * BLOCK:  # many languages: the largest goes first
                    most = max(sizes, key=sizes.get)
                    yield from (table(most, b) for b in blocks_of(held.pop(most)))
                    sizes.pop(most)
        for lang, texts in held.items():
            yield from (table(lang, b) for b in blocks_of(texts))

    return materialize(rows.mapInArrow(build, "lang string, n_words long, words binary, numbers binary").withColumn("block", F.monotonically_increasing_id()), "blocks")


def may_be_frequent(blocks: DataFrame, shards: int, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(block, shard, values): per block the fingerprints whose total count reaches ``least``."""

    def send(records):
        import pyarrow as pa

        for block, lang, words, numbers in read_blocks(records):
            prints = Fingerprints(words, numbers, lang)
            every = np.sort(np.concatenate([short(prints.of(n)[1], shards) for n in range(1, longest + 1)]))
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            counts = np.minimum(np.diff(np.append(first, len(every))), least)
            every = every[first]
            shard = (every >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            low = every.astype(np.uint32)
            used = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int64()),
                "data": pa.array([pack(low[cuts[s]:cuts[s + 1]], counts[cuts[s]:cuts[s + 1]]) for s in used], pa.binary())})

    def add(key, frame):
        import pandas as pd

        parts = [unpack(d) for d in frame["data"]]
        values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        total = np.bincount(at, np.concatenate([c for _, c in parts]))
        good = total[at] >= least
        edges = np.cumsum([0] + [len(v) for v, _ in parts])
        out = [v[good[a:b]] for (v, _), a, b in zip(parts, edges, edges[1:])]
        rows = [i for i, v in enumerate(out) if len(v)]
        return pd.DataFrame({"block": frame["block"].iloc[rows].to_numpy(), "shard": int(key[0]), "values": [out[i].astype("<u4").tobytes() for i in rows]})

    sent = blocks.select("block", "lang", "words", "numbers").mapInArrow(send, "shard int, block long, data binary")
    return sent.groupBy("shard").applyInPandas(add, "block long, shard int, values binary")


def read_blocks(records):
    for batch in records:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i]  # noqa: B023, E731
            yield get("block").as_py(), get("lang").as_py(), get("words").as_py().split(b" "), np.frombuffer(get("numbers").as_py(), np.int32)


def same_words(numbers: np.ndarray, start: np.ndarray, fp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first start, count) of every distinct n-gram among ``start``; equal fingerprints are verified word by word."""
    order = np.lexsort((start, fp))
    start, fp = start[order], fp[order]
    first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])) if len(fp) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(fp))))
    window = np.arange(n)
    if len(fp) and (numbers[start[:, None] + window] != numbers[start[first][group][:, None] + window]).any():
        words, at, counts = np.unique(numbers[start[:, None] + window], axis=0, return_index=True, return_counts=True)
        return start[at], counts
    return start[first], np.diff(np.append(first, len(fp)))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, len, f), (lang, n)): phrases of up to ``longest`` words that occur ``least`` times, and word totals."""
    blocks = word_blocks(docs, text, lang)
    words = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    shards = max(SHARDS, 1 << (longest * total // SHARD).bit_length())
    hits = may_be_frequent(blocks, shards, longest, least)

    def write(left, right):
        import pandas as pd

        wanted = np.concatenate([(np.uint64(s) << np.uint64(32)) | np.frombuffer(v, "<u4").astype(np.uint64) for s, v in zip(right["shard"], right["values"])] or [np.zeros(0, np.uint64)])
        wanted.sort()
        out = []
        for row in left.itertuples():
            words, numbers = row.words.split(b" "), np.frombuffer(row.numbers, np.int32)
            prints = Fingerprints(words, numbers, row.lang)
            for n in range(1, longest + 1):
                start, fp = prints.of(n)
                key = short(fp, shards)
                place = np.searchsorted(wanted, key)
                good = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == key) if len(wanted) else np.zeros(0, np.int64)
                at, count = same_words(numbers, start[good], fp[good], n)
                phrases = [b" ".join([words[j] for j in row_]) for row_ in numbers[at[:, None] + np.arange(n)].tolist()]
                out.append(pd.DataFrame({"lang": row.lang, "phrase": phrases, "len": n, "f": count}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "phrase": [], "len": [], "f": []})

    texts = blocks.select("block", "lang", "words", "numbers").groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(write, "lang string, phrase binary, len int, f long")
    counted = texts.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "len").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return materialize(counted, "phrases"), words


def part(phrase: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language, by their lowest-scoring cut."""
    found, totals = frequent_phrases(docs, text, lang, longest, least)
    big = lambda c: F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")
    several = found.filter("len > 1").withColumnRenamed("f", "a")
    inside = several.filter("len > 2").select(
        "lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("len") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("len") - m + 1), lambda i: part(F.col("phrase"), i, m))))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("covering"))
    alone = several.join(inside, ["lang", "phrase"], "left").filter(F.col("covering").isNull() | (big("covering") * 100 < big("a") * cover))
    cuts = alone.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"), "len").withColumns({
        "left": part(F.col("phrase"), F.lit(1), F.col("k")), "right": part(F.col("phrase"), F.col("k") + 1, F.col("len") - F.col("k"))})
    for side in ("left", "right"):
        count = found.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0]))
        cuts = cuts.join(count, ["lang", side])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    # the best of each slice first, so that no task ranks a whole language
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    slices = worst.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    slices = slices.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    best = slices.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
