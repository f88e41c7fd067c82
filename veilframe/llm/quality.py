"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

``y = b + sum w_f x_f + 1/2 sum_k ((sum_f v_fk x_f)^2 - sum_f v_fk^2 x_f^2)``: all pairwise interactions in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilframe.llm.common import Memo, bounded_sample, platt, text_chunks

BUCKETS, RANK = 1 << 14, 8
STATS = 24  # dense features after the hashed ones
_KINDS = bytes(0 if b in b" \t\n\r\x0b\x0c" else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b < 128 else 5 for b in range(256))


@dataclass
class Model:
    bias: float
    w: object
    v: object
    mean: object
    scale: object
    slope: float = 1.0
    shift: float = 0.0


def _bucket(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter((xxhash.xxh32_intdigest(w) % BUCKETS for w in words), np.int32, len(words))


def structure(text: bytes, words: list[bytes], lines: list[bytes]):
    """Statistics of a text's form; every value is bounded, and the same for a text and its repetition up to length."""
    import numpy as np

    kinds = np.bincount(np.frombuffer(text.translate(_KINDS), np.uint8), minlength=6)[:6] / max(1, len(text))
    n, k = max(1, len(words)), max(1, len(lines))
    marks = [text.count(m) for m in (b".", b",", b"!", b"|", b"#", b"$", b"%", b"&", b"*", b"<", b"{")]
    return np.array([*kinds, *(min(1.0, m / n) for m in marks), len(set(words)) / n, len(set(lines)) / k, min(20.0, len(text) / n) / 20,
                     np.log1p(n) / 12, np.log1p(k) / 10, min(1.0, k / n), 1.0 if not words else 0.0])


def _features(memo: Memo, texts: list):
    """Per text: bucket numbers, their values, and the structure statistics."""
    import numpy as np

    for start, part in text_chunks(texts):
        words = [(t or b"").lower().split() for t in part]
        at = [np.fromiter(map(memo.__getitem__, w), np.int64, len(w)) for w in words]
        buckets = memo.settle()
        for t, w, ids in zip(part, words, at):
            t = t or b""
            counts = np.bincount(buckets[ids], minlength=1) if len(ids) else np.zeros(1, np.int64)
            f = np.flatnonzero(counts)
            x = np.log1p(counts[f]).astype(np.float32)
            norm = np.sqrt((x * x).sum())
            yield f, x / norm if norm else x, structure(t, w, t.split(b"\n"))
        memo.trim()


def _score(model: Model, f, x, s):
    import numpy as np

    dense = np.clip((s - model.mean) / model.scale, -4, 4) / 4
    f, x = np.concatenate([f, BUCKETS + np.arange(STATS)]), np.concatenate([x, dense])
    v = model.v[f] * x[:, None]
    sums = v.sum(axis=0)
    return model.bias + float(model.w[f] @ x) + 0.5 * float((sums * sums).sum() - (v * v).sum()), f, x, sums


def fit(rows: list[tuple[bytes, int]], epochs: int = 8, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Adagrad on logistic loss over a bounded list of (text, label), then Platt calibration on the last fifth."""
    import numpy as np

    rng = np.random.default_rng(7)
    size = BUCKETS + STATS
    if not rows:
        return Model(0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), np.zeros(STATS), np.ones(STATS))
    feats = list(_features(Memo(_bucket), [r[0] for r in rows]))
    y = np.array([r[1] for r in rows], np.float64)
    stats = np.array([f[2] for f in feats])
    model = Model(0.0, np.zeros(size, np.float64), rng.normal(0, 0.02, (size, RANK)), stats.mean(axis=0), stats.std(axis=0) + 1e-3)
    share = min(0.99, max(0.01, y.mean()))
    model.bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    held = max(1, len(rows) // 5) if len(rows) >= 50 else 0
    order = rng.permutation(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(order[held:]):
            z, f, x, sums = _score(model, *feats[i])
            g = 1 / (1 + np.exp(-z)) - y[i]
            dw = g * x + decay * model.w[f]
            dv = g * (x[:, None] * sums - model.v[f] * (x * x)[:, None]) + decay * model.v[f]
            gw[f] += dw * dw
            gv[f] += dv * dv
            gb += g * g
            model.w[f] -= rate * dw / np.sqrt(gw[f])
            model.v[f] -= rate * 0.3 * dv / np.sqrt(gv[f])
            model.bias -= rate * g / np.sqrt(gb)
    if held:
        z = np.array([_score(model, *feats[i])[0] for i in order[:held]])
        model.slope, model.shift = platt(z, y[order[:held]])
    model.w, model.v = model.w.astype(np.float32), model.v.astype(np.float32)
    return model


def train(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", per_class: int = 1500) -> Model:
    """Model from at most about ``per_class`` labelled rows of each class (null labels and texts take no part)."""
    rows = bounded_sample(labelled.filter(F.col(label).isin(0, 1) & F.col(text).isNotNull()), key, per_class, by=label)
    got = [(int(r[1]), bytes(r[0])) for r in rows.select(F.col(text).cast("binary"), F.col(label)).toLocalIterator()]
    return fit([(t, y) for y, t in sorted(got)])


def score_quality(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability that a text is good. Null counts as empty; an empty text has a score from its form alone.

    Whole texts are scored; equal texts score alike; an existing column ``out`` is replaced.
    """
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        memo = Memo(_bucket)
        for batch in batches:
            z = np.array([_score(model, *f)[0] for f in _features(memo, batch.to_pylist())])
            yield pa.array(1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -30, 30))), pa.float64())

    return docs.withColumn(out, score(F.col(text).cast("binary")))
