"""Language identification by interpolated Kneser-Ney character models, one per language.

Words (letters only, small) are sequences of characters between a start and an end mark, so a text's cross-entropy is
a sum over its words and each distinct word is evaluated once per task. N-grams of all languages lie in one sorted
array of 64-bit hashes per order, with one column per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilframe.llm.common import LETTERS, Memo, bounded_sample, text_chunks

ORDER, DISCOUNT = 4, 0.75
START, END = 2, 3


@dataclass
class Model:
    languages: list
    keys: list          # per order: sorted hashes of n-grams (and, for contexts, of their histories)
    grams: list         # per order: discounted probability, n-grams x languages
    contexts: list      # per order: sorted hashes of histories
    weights: list       # per order: interpolation weight of a history, histories x languages
    floor: float        # 1 / (1 + size of the alphabet)
    worst: float = 1e9  # calibrated: cross-entropy above which a text is none of the languages


def _points(words: list[bytes]):
    """Code points of all words with marks, and the place of each within its word."""
    import numpy as np

    text = [w.decode("utf-8", "replace").lower() for w in words]
    size = np.fromiter(map(len, text), np.int64, len(text)) + ORDER  # ORDER - 1 starts and one end
    ends = np.cumsum(size)
    points = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint64)
    flat = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(text)), size)
    place = np.arange(len(points)) - np.repeat(ends - size, size)
    points[(place >= ORDER - 1) & (place < size[owner] - 1)] = flat
    points[ends - 1] = END
    return points, owner, place


def _hashes(points, n: int):
    """Hash of the n points that end at each place (places without that many are given up by the caller)."""
    import numpy as np

    h = np.full(len(points), n, np.uint64)
    for i in range(n - 1, -1, -1):
        shifted = points if i == 0 else np.concatenate([np.zeros(i, np.uint64), points[:-i]])
        h = (h ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def fit(words: list[tuple[str, bytes, int]]) -> Model:
    """Model from (language, word, count) rows, few enough to hold: they come from a bounded sample."""
    import numpy as np

    languages = sorted({w[0] for w in words})
    index = {x: i for i, x in enumerate(languages)}
    points, owner, place = _points([w[1] for w in words])
    lang = np.fromiter((index[w[0]] for w in words), np.int64, len(words))[owner]
    times = np.fromiter((w[2] for w in words), np.float64, len(words))[owner]
    inside = place >= ORDER - 1
    L, alphabet = len(languages), len(np.unique(points)) + 1
    grams, keys, contexts, weights = [], [], [], []
    for n in range(1, ORDER + 1):
        h, hist = _hashes(points, n), _hashes(np.concatenate([np.zeros(1, np.uint64), points[:-1]]), n - 1)
        k, at = np.unique(h[inside], return_inverse=True)
        counts = np.zeros((len(k), L))
        if n == ORDER:
            np.add.at(counts, (at, lang[inside]), times[inside])
        else:  # continuation: in how many different places to the left
            wide = _hashes(points, n + 1)[inside]
            _, first = np.unique((wide ^ lang[inside].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9), return_index=True)
            np.add.at(counts, (at[first], lang[inside][first]), 1.0)
        ck, cat = np.unique(hist[inside], return_inverse=True)
        of = np.zeros(len(k), np.int64)
        of[at] = cat
        total, kinds = np.zeros((len(ck), L)), np.zeros((len(ck), L))
        np.add.at(total, of, counts)
        np.add.at(kinds, of, (counts > 0).astype(float))
        safe = np.maximum(total, 1e-12)
        grams.append((np.maximum(counts - DISCOUNT, 0) / safe[of]).astype(np.float32))
        weights.append(np.where(total > 0, DISCOUNT * kinds / safe, 1.0).astype(np.float32))
        keys.append(k)
        contexts.append(ck)
    return Model(languages, keys, grams, contexts, weights, 1.0 / alphabet)


def _look(table, rows, h, absent):
    import numpy as np

    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    out = rows[at]
    out[table[at] != h] = absent
    return out


def evaluate(model: Model, words: list[bytes]):
    """Per word: log2 probability in each language, and the number of characters with the end mark."""
    import numpy as np

    points, owner, place = _points(words)
    inside = place >= ORDER - 1
    p = np.full((int(inside.sum()), len(model.languages)), model.floor, np.float32)
    before = np.concatenate([np.zeros(1, np.uint64), points[:-1]])
    for n in range(1, ORDER + 1):
        g = _look(model.keys[n - 1], model.grams[n - 1], _hashes(points, n)[inside], 0.0)
        w = _look(model.contexts[n - 1], model.weights[n - 1], _hashes(before, n - 1)[inside], 1.0)
        p = g + w * p
    starts = np.searchsorted(owner[inside], np.arange(len(words)))
    bits = np.add.reduceat(np.log2(np.maximum(p, 1e-12)), starts, axis=0)
    return np.hstack([bits, np.bincount(owner[inside], minlength=len(words))[:, None]]).astype(np.float32)


def entropies(model: Model, memo: Memo, texts: list):
    """Cross-entropy per character of each text in each language; not a number for a text without letters."""
    import numpy as np

    out = np.full((len(texts), len(model.languages)), np.nan)
    for start, part in text_chunks(texts):
        words = [t.translate(LETTERS).split() if t else () for t in part]
        at = [np.fromiter(map(memo.__getitem__, w), np.int64, len(w)) for w in words]
        rows = memo.settle()
        for i, ids in enumerate(at):
            if len(ids):
                s = rows[ids].sum(axis=0, dtype=np.float64)
                out[start + i] = -s[:-1] / s[-1]
        memo.trim()
    return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1200) -> Model:
    """Model from at most about ``per_language`` labelled rows of each language, and the rejection bound.

    Calibration: the bound is the 99.9th percentile of the training texts' own cross-entropy plus a tenth.
    """
    import numpy as np

    rows = bounded_sample(labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()), key, per_language, by=lang)
    sample = [(r[0], bytes(r[1])) for r in rows.select(lang, F.col(text).cast("binary")).toLocalIterator()]
    counts: dict = {}
    for tag, data in sample:
        for w in data.translate(LETTERS).split():
            counts[tag, w] = counts.get((tag, w), 0) + 1
    model = fit([(tag, w, n) for (tag, w), n in counts.items()]) if counts else Model([], [], [], [], [], 1.0)
    if counts:
        own = np.nanmin(entropies(model, Memo(lambda w: evaluate(model, w)), [d for _, d in sample[::7]]), axis=1)
        own = own[~np.isnan(own)]
        model.worst = float(np.quantile(own, 0.999) * 1.1) if len(own) else 1e9
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_pred") -> DataFrame:
    """Adds ``out`` (language of lowest cross-entropy, ``und`` without letters), ``score`` (0 to 1) and ``accepted``.

    ``score`` is the winner's share of 2 to the minus cross-entropy over all languages, sharpened by the text's own
    length up to 64 characters. ``accepted`` is false where even the best model finds the text too strange. A null
    or letterless text: ``und``, 0, false. A tie goes to the first language by name. Columns of these names are replaced.
    """
    languages = model.languages

    @F.arrow_udf("struct<lang string, score double, accepted boolean>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import re

        memo = Memo(lambda w: evaluate(model, w))
        for batch in batches:
            texts = batch.to_pylist()
            if not languages:
                best, score, ok = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            else:
                h = entropies(model, memo, texts)
                void = np.isnan(h[:, 0])
                for i in np.flatnonzero(~void):  # other scripts' marks are no letters; look closely only where no ASCII letter is
                    t = texts[i]
                    if not re.search(rb"[A-Za-z]", t) and not any(c.isalpha() for c in t.decode("utf-8", "replace")):
                        void[i] = True
                h[void] = 0
                at = h.argmin(axis=1)
                size = np.fromiter((min(64, len(t) if t else 0) for t in texts), np.float64, len(texts))
                share = np.exp2(-(h - h.min(axis=1, keepdims=True)) * size[:, None])
                score = np.where(void, 0.0, 1.0 / share.sum(axis=1))
                best = ["und" if v else languages[a] for v, a in zip(void, at)]
                ok = ~void & (h.min(axis=1) <= model.worst)
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(list(ok), pa.bool_())], ["lang", "score", "accepted"])

    made = [out, "score", "accepted"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    return docs.withColumn("__l", judge(F.col(text).cast("binary"))).select(*kept, F.col("__l.lang").alias(out), "__l.score", "__l.accepted")
