"""Toxicity by a gap-weighted subsequence string kernel and a linear support vector machine on Nystroem features.

Two strings are alike if they share subsequences of three characters, each weighted by ``DECAY`` to the power of the
stretch it spans; so a gap or an inserted character lowers the likeness instead of ending it. The units compared with
the landmarks are a sentence's words, without marks and digits, and runs of single letters joined into one
("i d i o t"). A sentence's score is that of its most toxic unit, a text's that of its worst sentence. Since a unit's
score depends on the unit alone, each distinct one is evaluated once per task.

Training sees labels of whole texts only, so it looks for witnesses: a toxic text's sentences are represented by the
unit that the model finds worst, and model and witnesses are improved in turn.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilframe.llm.common import Memo, bounded_sample, isotonic, release, text_chunks

#: Characters of a subsequence, weight of each place it spans, and the power of the normalised kernel (still a kernel).
LENGTH, DECAY, POWER = 3, 0.7, 3
#: Landmarks from toxic and from clean sentences; longest landmark; longest piece of a word looked at at once.
TOXIC, CLEAN, LONGEST, WINDOW = 96, 48, 14, 24
#: Weight of a toxic word with an inserted character beside the word itself, in training.
BENT = 0.25
#: Clean words nearest to the landmarks that the machine is trained against.
HARD = 20_000
#: The kernel counts as zero for pairs whose longest common subsequence is below this share of the landmark.
OVERLAP = 0.6
#: Words whose scores a worker process keeps.
WORDS = 250_000
_BLANKS = bytes(32 if b in b"\t\n\r\x0b\x0c" else b | 32 if 65 <= b <= 90 else b for b in range(256))
_DROP = bytes(b for b in range(33, 127) if not chr(b).isalpha())
_RUN = re.compile(rb"(?<![^ ])[a-z](?: +[a-z]){2,}(?![^ ])")


#: Scores of words by model, one model at a time: the tasks of a worker process share them.
_SCORED: dict = {}


@dataclass
class Model:
    landmarks: list
    weights: object      # of the kernel values with the landmarks
    bias: float
    knots: tuple = ((0.0,), (0.0,))   # score -> probability, interpolated

    def memo(self) -> Memo:
        """Word -> score; words that other tasks of this process have met are not evaluated again."""
        key = (tuple(self.landmarks), bytes(self.weights), self.bias)
        if key not in _SCORED:
            _SCORED.clear()
            kernel = Kernel(self.landmarks)
            _SCORED[key] = Memo(lambda w: evaluate(self, kernel, w), WORDS)
        return _SCORED[key]

    def probability(self, z):
        import numpy as np

        return np.interp(z, *self.knots)


def units(text: bytes) -> list[bytes]:
    """Words of a text without marks and digits, and joined runs of three or more single letters."""
    plain = text.translate(_BLANKS, _DROP)
    words = plain.split()
    for run in _RUN.findall(plain):
        words.append(run.replace(b" ", b""))
    return words


def subsequence_kernel(equal, decay: float = DECAY, length: int = LENGTH):
    """Kernel of many string pairs at once from their equality matrices (pairs x letters x letters)."""
    import numpy as np

    pairs, ls, lt = equal.shape
    e = equal.astype(np.float32)
    tri = np.array([[decay ** (j - i) if j >= i else 0.0 for j in range(lt)] for i in range(lt)], np.float32)
    prev = np.ones((pairs, ls + 1, lt + 1), np.float32)
    for _ in range(length - 1):
        cur = np.zeros_like(prev)
        for a in range(ls):
            cur[:, a + 1, 1:] = decay * cur[:, a, 1:] + (e[:, a] * (decay * decay) * prev[:, a, :-1]) @ tri
        prev = cur
    return (decay * decay) * np.einsum("pij,pij->p", e, prev[:, :-1, :-1])


def _codes(strings: list[str], width: int, pad: int):
    import numpy as np

    out = np.full((len(strings), max(1, width)), pad, np.int32)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out, size


class Kernel:
    """Normalised kernel values between strings and fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        import numpy as np

        self.landmarks = landmarks
        self.codes, self.size = _codes(landmarks, max(map(len, landmarks), default=1), -2)
        self.own = np.sqrt(np.maximum(subsequence_kernel((self.codes[:, :, None] == self.codes[:, None, :]) & (self.codes[:, :, None] >= 0)), 1e-12)) if landmarks else np.zeros(0)
        letters = sorted({int(c) for c in self.codes.ravel() if c >= 0})
        self.letter = {c: i + 1 for i, c in enumerate(letters)}
        self.masks = np.zeros((len(letters) + 1, len(landmarks)), np.uint32)
        for m, row in enumerate(self.codes):
            for j, c in enumerate(row):
                if c >= 0:
                    self.masks[self.letter[int(c)], m] |= np.uint32(1 << j)
        self.need = np.maximum(LENGTH, np.ceil(OVERLAP * self.size)).astype(np.int64)

    def _chunk(self, strings: list[str]):
        import numpy as np

        codes, size = _codes(strings, max(map(len, strings)), -1)
        known = np.zeros(max(self.letter, default=0) + 2, np.int32)
        known[list(self.letter)] = list(self.letter.values())
        index = np.where((codes >= 0) & (codes < len(known)), known[np.clip(codes, 0, len(known) - 1)], 0)
        s = np.full((len(strings), len(self.landmarks)), 0xFFFFFFFF, np.uint32)
        for i in range(codes.shape[1]):  # longest common subsequence, one bit per landmark letter
            u = s & self.masks[index[:, i]]
            s = (s + u) | (s - u)
        common = np.bitwise_count(~s & ((np.uint64(1) << self.size.astype(np.uint64)) - np.uint64(1)).astype(np.uint32))
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        a, m = np.nonzero(common >= self.need)
        if len(a):
            live = np.unique(a)
            own = np.zeros(len(strings), np.float32)
            for i in range(0, len(live), 1500):
                c = codes[live[i:i + 1500]]
                both = (c[:, :, None] == c[:, None, :]) & (c[:, :, None] >= 0)
                own[live[i:i + 1500]] = np.sqrt(np.maximum(subsequence_kernel(both), 1e-12))
            order = np.argsort(self.size[m], kind="stable")  # short landmarks make small tables
            a, m = a[order], m[order]
            for i in range(0, len(a), 6000):
                x, y = a[i:i + 6000], m[i:i + 6000]
                shape = self.codes[y][:, None, :int(self.size[y[-1]])]
                out[x, y] = subsequence_kernel(codes[x][:, :, None] == shape) / (own[x] * self.own[y])
        return out ** POWER

    def __call__(self, strings: list[str]):
        import numpy as np

        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        if not self.landmarks or not strings:
            return out
        parts, owner = [], []  # words longer than the window are looked at in overlapping windows
        for i, s in enumerate(strings):
            for at in range(0, max(1, len(s) - WINDOW // 2), WINDOW // 2) if len(s) > WINDOW else (0,):
                parts.append(s[at:at + WINDOW])
                owner.append(i)
        owner, sizes = np.array(owner), np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(np.fromiter(map(len, parts), np.int64, len(parts)), kind="stable")
        order = order[np.searchsorted(np.fromiter((len(parts[i]) for i in order), np.int64, len(order)), LENGTH):]
        for i in range(0, len(order), 4000):
            at = order[i:i + 4000]
            values, row = self._chunk([parts[j] for j in at]), owner[at]
            whole = sizes[row] <= WINDOW  # seen in one window
            out[row[whole]] = values[whole]
            if not whole.all():
                np.maximum.at(out, row[~whole], values[~whole])
        return out


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower()


def evaluate(model: Model, kernel: Kernel, words: list[bytes]):
    import numpy as np

    out = np.empty(len(words), np.float32)
    for i in range(0, len(words), 8000):  # a block of kernel values at a time
        out[i:i + 8000] = kernel(list(map(_text, words[i:i + 8000]))) @ model.weights + model.bias
    return out


def _svm(x, y, weight, cost: float = 3000.0):
    """L2 support vector machine by Newton's method on the squared hinge; weighted rows, classes balanced."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    c = cost * weight / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
    ridge = np.eye(x.shape[1]) * 0.01
    w = np.zeros(x.shape[1])
    for _ in range(30):
        gap = 1 - y * (x @ w)
        on = gap > 0
        grad = ridge @ w - 2 * ((c * y * gap * on) @ x)
        hess = ridge + sum(2 * part.T.astype(float) @ (v[:, None] * part) for part, v in ((x[i:i + 4000][on[i:i + 4000]], c[i:i + 4000][on[i:i + 4000]]) for i in range(0, len(x), 4000)))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _bent(word: str) -> list[str]:
    """The word with a strange character inserted, and with its middle character doubled."""
    m = len(word) // 2
    return [word[:m] + "\x7f" + word[m:], word[:m] + word[m - 1:]]


def fit(rows: list[tuple[bytes, int]], prior: float | None = None, rounds: int = 4) -> Model:
    """Model from a bounded list of (text, label). ``prior``: share of toxic texts where the model will be used."""
    import numpy as np

    number: dict[bytes, int] = {}   # words by number, so that texts are small arrays
    texts = []
    for t, y in rows:
        ss = [np.array([number.setdefault(w, len(number)) for w in units(s)], np.int32) for s in re.split(rb"[.!?\n]+", t)]
        texts.append(([s for s in ss if len(s)], y))
    vocabulary = list(map(_text, number))
    size = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
    del number
    bad, good = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for ss, y in texts:
        if ss:
            (bad if y else good)[np.unique(np.concatenate(ss))] += 1
    n1, n0 = sum(y for _, y in texts), sum(1 - y for _, y in texts)
    if not n1 or not n0 or not vocabulary:
        return Model([], np.zeros(0, np.float32), 0.0, ((0.0,), (1.0 if n1 else 0.0,)))
    middle = (bad + good + 1) / (n1 + n0 + 2)
    excess = (bad / n1 - good / n0) / np.sqrt(middle * (1 - middle) * (1 / n1 + 1 / n0))
    usable = (size > LENGTH) & (size <= LONGEST)
    landmarks: list[str] = []
    for i in np.lexsort((vocabulary, -np.where(usable & (bad >= 3), excess, -np.inf)))[:400]:
        if len(landmarks) == TOXIC or excess[i] < 3 or not usable[i] or bad[i] < 3:
            break
        if not landmarks or Kernel(landmarks)([vocabulary[i]]).max() < 0.8:
            landmarks.append(vocabulary[i])
    if not landmarks:
        return Model([], np.zeros(0, np.float32), 0.0, ((0.0,), (n1 / (n1 + n0),)))
    first = np.where(size >= LENGTH, excess, -np.inf)
    witness = [i for ss, y in texts if y for i in (s[first[s].argmax()] for s in ss) if first[i] >= 3]
    model = Model(landmarks, np.zeros(len(landmarks), np.float32), 0.0)
    k = np.zeros((len(vocabulary), TOXIC + CLEAN), np.float16)  # kernel values, allocated once and filled in blocks
    filled = 0

    def scores(weights, bias):
        out = np.full(len(vocabulary), bias, np.float32)
        for i in range(0, len(vocabulary), 8000):
            out[i:i + 8000] += k[i:i + 8000, :filled].astype(np.float32) @ weights
        return out

    for turn in range(rounds):
        kernel = Kernel(model.landmarks)
        among = kernel(model.landmarks).astype(float)
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T  # Nystroem map
        fresh = Kernel(model.landmarks[filled:])
        for i in range(0, len(vocabulary), 8000):
            k[i:i + 8000, filled:len(model.landmarks)] = fresh(vocabulary[i:i + 8000])
        filled = len(model.landmarks)
        near = k[:, :filled].max(axis=1)
        clean = np.flatnonzero((good > 0) & (near > 0))
        clean = clean[np.argsort(-near[clean], kind="stable")[:HARD]]
        seen = Counter(map(int, witness))
        bent = [v for i in seen for v in _bent(vocabulary[i])]
        x = (np.vstack([k[list(seen), :filled].astype(np.float32), kernel(bent), k[clean, :filled].astype(np.float32)]) @ root.astype(np.float32)).astype(np.float32)
        weight = np.concatenate([list(seen.values()), np.repeat(list(seen.values()), 2) * BENT, good[clean]]).astype(float)
        w, bias = _svm(x, np.concatenate([np.ones(3 * len(seen)), -np.ones(len(clean))]), weight)
        model.weights, model.bias = (root @ w).astype(np.float32), bias
        del x
        f = scores(model.weights, bias)
        new = [i for ss, y in texts if y for i in (s[f[s].argmax()] for s in ss) if f[i] > 0 and excess[i] > 1]
        witness = new or witness
        if turn < rounds - 1:  # clean words that look most toxic become landmarks
            wrong = clean[(excess[clean] < 2) & usable[clean] & (f[clean] > -0.8)]
            wrong = wrong[np.argsort(-good[wrong] * (f[wrong] + 1), kind="stable")]
            known = set(model.landmarks)
            model.landmarks = model.landmarks + [v for v in dict.fromkeys(vocabulary[i] for i in wrong) if v not in known][:CLEAN // (rounds - 1)]
    z = np.array([f[np.concatenate(ss)].max() if ss else model.bias for ss, _ in texts])
    y = np.array([y for _, y in texts])
    share = prior if prior and 0 < prior < 1 else n1 / (n1 + n0)
    model.knots = isotonic(z, y, np.where(y > 0, share / n1, (1 - share) / n0) * (n1 + n0))
    return model


def train(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", per_class: int = 1500) -> Model:
    """Model from at most about ``per_class`` labelled rows of each class (null labels and texts take no part)."""
    known = labelled.filter(F.col(label).isin(0, 1) & F.col(text).isNotNull())
    counts = dict(known.groupBy(label).count().collect())
    rows = bounded_sample(known, key, per_class, by=label)
    whole = sum(counts.values())
    prior = counts.get(1, 0) / whole if whole else None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((int(y), bytes(t)) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        model = fit([(t, y) for y, t in got], prior=prior)
        del got
        release()
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    # the sample is bounded and learned from in one task, so that the driver holds the model only
    sample = rows.select(F.col(text).cast("binary").alias("text"), F.col(label).cast("int").alias("label")).repartition(1)
    made = sample.mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit([], prior=prior)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability that a text is toxic. Null counts as empty; a text without a word has the lowest score.

    Whole texts are scored, words of any length in overlapping windows; equal texts score alike; an existing column
    ``out`` is replaced.
    """
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        memo = model.memo()
        for batch in batches:
            texts = batch.to_pylist()
            z = np.full(len(texts), model.bias, np.float64)
            for start, part in text_chunks(texts):
                at = [np.fromiter(map(memo.__getitem__, w), np.int64, len(w)) for w in (units(t) if t else () for t in part)]
                rows = memo.settle()
                for i, ids in enumerate(at):
                    if len(ids):
                        z[start + i] = rows[ids].max()
                memo.trim()
            yield pa.array(model.probability(z), pa.float64())

    return docs.withColumn(out, score(F.col(text).cast("binary")))
