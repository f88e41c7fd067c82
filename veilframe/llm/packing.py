"""Packing token sequences by bin completion.

Texts become pieces of at most ``size`` tokens; whole pieces are sequences of their own. The rest is cut into blocks
of bounded size by a hash, each packed by itself: best fit decreasing gives a first solution, and where that does not
reach the lower bound, branch and bound completes its loose bins anew around the largest piece left, over undominated
fillings only, until the waste bound or the node budget ends it. Bins that stay loose are packed once more together.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilframe.session import materialize

SIZE, BLOCK = 1024, 4096
#: Nodes of a search (at least 20 for each of its bins), bins in a group at least, fillings of a bin to try, and combinations looked at for them.
NODES, GROUP, WAYS, TRIES = 6000, 400, 12, 120
PIECE = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
_CODERS: dict = {}

# Fixed value: how byte-level tokenizers split a text before they merge.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(kind: dict) -> dict[bytes, int] | None:
    """Token bytes to ids of a byte-level merge list; None for a tokenizer that does anything else.

    Ids must grow with the merges: then the merge of the lowest id is the one that the list names first.
    """
    model, split = kind["model"], kind["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or kind["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]  # the others are written as 256, 257, ...
    sign = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    tokens = [*sign, *(a + b for a, b in pairs)]
    ids = [model["vocab"].get(t) for t in tokens]
    merged = ids[256:]
    if None in ids or any(a >= b for a, b in zip([max(ids[:256]), *merged], merged)):
        return None
    return {bytes(sign[c] for c in t): i for t, i in zip(tokens, ids)}


def stable(char: str) -> bool:
    """Is the character a letter, number, blank or none of them by old and new tables alike?"""
    import unicodedata

    def group(category: str) -> str:
        return category[0] if category[0] in "LNZ" else "S"

    now = unicodedata.category(char)
    return now != "Cn" and group(now) == group(unicodedata.ucd_3_2_0.category(char))


class Coder:
    """Token ids of whole texts, exactly as the tokenizer file gives them without special tokens around.

    A byte-level merge list is run by ``tiktoken``, which gives the same ids in a third of the time.  Texts that name an
    added token, hold a run of a thousand blanks (its search runs out of stack at millions), or characters that tables of
    different age may split differently, and all texts of other kinds of tokenizers, are coded by ``tokenizers``.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.safe, self.rare = Tokenizer.from_file(path), {chr(i) for i in range(128)}, set()
        kind = json.loads(self.tokenizer.to_str())
        ranks = byte_ranks(kind)
        self.fast = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.apart = re.compile("|".join([r"\s{1000}", *(re.escape(t["content"]) for t in kind["added_tokens"])]))

    def _as_split(self, text: str) -> bool:
        if not self.fast or self.apart.search(text):
            return False
        if text.isascii():
            return True
        signs = set(text) - self.safe
        for c in signs - self.rare:
            (self.safe if stable(c) else self.rare).add(c)
        return not signs & self.rare

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        import numpy as np

        def data(ids):
            return np.array(ids, "<u4").tobytes()

        out = [data(self.fast.encode_ordinary(t)) if self._as_split(t) else None for t in texts]
        late = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(late, self.tokenizer.encode_batch_fast([texts[i] for i in late], add_special_tokens=False)):
            out[i] = data(found.ids)
        return out


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only texts above ``size`` are cut, the first piece takes the odd length."""
    if total <= size:
        return [(0, total)]
    first = total % size or size
    return [(0, first)] + [(s, size) for s in range(first, total, size)]


def tokenize(docs: DataFrame, path: str, text: str = "text", end: int = 2, size: int = SIZE) -> DataFrame:
    """Adds ``__pieces``: piece, start, length and crc32 of the ids, of each text's ids plus ``end``."""
    @F.arrow_udf(PIECE)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zlib

        from veilframe.llm.common import text_chunks

        coder = _CODERS.setdefault(path, None) or Coder(path)
        _CODERS[path] = coder
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        last = end.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for _, part in text_chunks(batch.to_pylist(), 2_000_000):
                for ids in coder(part):
                    ids += last
                    rows.append([{"piece": i, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[4 * s:4 * (s + n)])} for i, (s, n) in enumerate(cut(len(ids) // 4, size))])
            yield pa.array(rows, kind)

    return docs.withColumn("__pieces", pieces(F.coalesce(F.col(text), F.lit(""))))


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best fit decreasing over the given lengths (largest first): bins of positions."""
    bins: list[list[int]] = []
    room: list[int] = []       # rooms in use, sorted
    by_room: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        at = bisect_right(room, n - 1)
        if at == len(room):
            bins.append([i])
            left, b = size - n, len(bins) - 1
        else:
            r = room[at]
            b = by_room[r].pop()
            if not by_room[r]:
                del by_room[r]
                room.pop(at)
            bins[b].append(i)
            left = r - n
        if left not in by_room:
            by_room[left] = []
            room.insert(bisect_right(room, left), left)
        by_room[left].append(b)
    return bins


def fillings(counts: dict[int, int], room: int, most: int = WAYS, tries: int = TRIES) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with any number of the pieces left (length -> number), fullest first.

    A filling is dominated if a piece that is left fits beside it, or in the place of a smaller one of its own. At most
    ``tries`` combinations are looked at, larger pieces first, and ``most`` are returned.
    """
    sizes = sorted((n for n in counts if n <= room), reverse=True)
    found: list[tuple[int, ...]] = []
    left, chosen, budget = dict(counts), [], tries
    # depth first: each level goes down the sizes from where the level above stands
    levels = [[0, room]]
    while levels and budget > 0:
        i, space = levels[-1]
        while i < len(sizes) and (sizes[i] > space or not left[sizes[i]]):
            i += 1
        if i == len(sizes):
            if chosen and len(levels) == len(chosen) + 1 and levels[-1][0] >= 0:
                budget -= 1
                larger = {n: min((m for m in sizes if m > n and left[m]), default=0) for n in set(chosen)}
                fits = any(left[m] and m <= space for m in sizes[-1:]) or any(m and m - n <= space for n, m in larger.items())
                if not fits:
                    found.append(tuple(chosen))
                    if space == 0 and len(found) >= most:
                        break
            levels.pop()
            if chosen and levels:
                left[chosen.pop()] += 1
            continue
        levels[-1][0] = i + 1
        n = sizes[i]
        left[n] -= 1
        chosen.append(n)
        levels.append([i, space - n])
    return sorted(set(found), key=lambda f: (-sum(f), len(f), f))[:most] or [()]


def improve(order: list[int], size: int, best: list[list[int]], nodes: int) -> list[list[int]]:
    """Fewer bins for the given lengths by bin completion, or ``best``, the incumbent.

    Branch and bound: each level completes a bin around the largest piece left with one of its undominated fillings; a
    branch ends where its waste shows that it cannot beat the incumbent, the search at the lower bound or after ``nodes``.
    """
    total, bound = sum(order), -(-sum(order) // size)
    counts: dict[int, int] = {}
    for n in order:
        counts[n] = counts.get(n, 0) + 1
    path: list[tuple[int, ...]] = []

    def take(f, sign):
        for n in f:
            counts[n] = counts.get(n, 0) + sign
            if not counts[n]:
                del counts[n]

    def ways():
        largest = max(counts)
        take((largest,), -1)
        out = [(largest, *f) for f in fillings(counts, size - largest)]
        take((largest,), 1)
        return iter(out)

    stack, waste = [ways()], 0
    while stack and nodes > 0 and len(best) > bound:
        nxt = next(stack[-1], None)
        if nxt is None:
            stack.pop()
            if path:
                waste -= size - sum(path[-1])
                take(path.pop(), 1)
            continue
        nodes -= 1
        lost = size - sum(nxt)
        if total + waste + lost > (len(best) - 1) * size:  # too much waste to beat the incumbent
            continue
        take(nxt, -1)
        waste += lost
        path.append(nxt)
        if counts:
            stack.append(ways())
            continue
        if len(path) < len(best):
            best = [list(f) for f in path]
        waste -= lost
        take(path.pop(), 1)
    return best


def complete(lengths: list[int], size: int, nodes: int = NODES) -> list[list[int]]:
    """Bins of lengths: best fit decreasing, then bin completion of its loose bins.

    Full bins waste nothing and stay. The others are taken loosest first, in groups that waste at least one bin, since
    only those can do with one bin less; ``nodes`` bounds the search of a group and exceeds its bins many times.
    """
    order = sorted(lengths, reverse=True)
    bins = [[order[i] for i in b] for b in best_fit(order, size)]
    bound = -(-sum(order) // size)
    bins.sort(key=sum)
    done: list[list[int]] = []
    while len(done) + len(bins) > bound:
        waste = k = 0
        while k < len(bins) and (waste < size or k < GROUP):
            waste += size - sum(bins[k])
            k += 1
        if waste < size:
            break
        group, bins = bins[:k], bins[k:]
        done += improve(sorted((n for b in group for n in b), reverse=True), size, group, max(nodes, 20 * k))
    return done + bins


def _pack_block(size: int, nodes: int, base: int):
    def pack(t: pa.Table) -> pa.Table:
        import numpy as np

        lengths = t["length"].to_numpy()
        order = np.argsort(-lengths, kind="stable")
        free: dict[int, list[int]] = {}
        for i in order[::-1]:
            free.setdefault(int(lengths[i]), []).append(int(i))
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        fill = np.zeros(len(lengths), np.int64)
        block = t["__block"][0].as_py()
        for b, bin_ in enumerate(complete(lengths.tolist(), size, nodes)):
            at = 0
            for n in bin_:
                i = free[n].pop()
                sequence[i], offset[i], fill[i] = base + (block << 20) + b, at, sum(bin_)
                at += n
        for name, values in (("sequence_id", sequence), ("offset", offset), ("__fill", fill)):
            t = t.append_column(name, pa.array(values, pa.int64()))
        return t

    return pack


def _blocks(df: DataFrame, n: int, block: int, salt: str) -> DataFrame:
    return df.withColumn("__block", F.pmod(F.xxhash64("__row", F.lit(salt)), F.lit(max(1, -(-n // block)))).cast("long"))


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 2, size: int = SIZE, block: int = BLOCK, nodes: int = NODES) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone. Rows that repeat a key are packed each for itself; columns other than
    key and text are not read. An empty table gives an empty table. ``path``: the tokenizer's file.
    """
    made = tokenize(docs.select(F.col(key), F.col(text).alias("__text")), path, "__text", end, size)
    pieces = materialize(made.select(F.col(key).alias("__key"), F.inline_outer("__pieces")), "pieces").withColumn("__row", F.monotonically_increasing_id())
    columns = ["__key", "piece", "start", "length", "ids_crc32"]
    loose, full = pieces.filter(F.col("length") < size), pieces.filter(F.col("length") == size)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", __block long, sequence_id long, offset long, __fill long"
    n = loose.count()
    first = materialize(_blocks(loose, n, block, "first").groupBy("__block").applyInArrow(_pack_block(size, nodes, 0), kind), "packed")
    result = first
    if n > block:
        again = first.filter(F.col("__fill") < 0.97 * size).select(*pieces.columns)
        m = again.count()
        second = _blocks(again, m, block, "second").groupBy("__block").applyInArrow(_pack_block(size, nodes, 1 << 61), kind)
        result = first.filter(F.col("__fill") >= 0.97 * size).unionByName(second)
    whole = full.select(*columns, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = result.select(*columns, "sequence_id", "offset").unionByName(whole)
    return out.withColumnRenamed("__key", key)
