"""Shared helpers: byte-level words, bounded labelled samples, tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Every ASCII byte that is no letter becomes a blank, capitals become small; bytes of other characters stay.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column | str, m: int) -> Column:
    """crc32 of the key as text, modulo m; a null key has remainder -1."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % m, F.lit(-1))


def bounded_sample(df: DataFrame, key: str, bound: int, by: str | None = None) -> DataFrame:
    """About ``bound`` rows (per value of ``by``), chosen by a hash of the key: the same rows on every run.

    All rows are returned where there are fewer. Values of ``by`` are few (classes, languages).
    """
    group = [F.col(by)] if by else []
    counts = df.groupBy(*group).count().collect()
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000_007))
    keep = F.lit(False)
    for row in counts:
        share = min(1.0, bound / max(1, row["count"]))
        rule = place < math.ceil(1_000_000_007 * share)
        keep = keep | (rule & F.col(by).eqNullSafe(row[by]) if by else rule)
    return df.filter(keep)


class Memo(dict):
    """Word -> row of a table of scores, filled batch by batch and emptied when it holds ``limit`` words.

    ``evaluate`` maps a list of new words to an array with one row per word.
    """

    def __init__(self, evaluate, limit: int = 200_000):
        super().__init__()
        self.evaluate, self.limit, self.fresh, self.rows = evaluate, limit, [], None

    def __missing__(self, word):
        self[word] = at = len(self)
        self.fresh.append(word)
        return at

    def settle(self):
        """Scores of all words seen so far; call before indexing."""
        import numpy as np

        if self.fresh:
            new = self.evaluate(self.fresh)
            start = len(self) - len(self.fresh)
            if self.rows is None or len(self.rows) < len(self):
                grown = np.zeros((max(1024, 2 * len(self)), *new.shape[1:]), new.dtype)
                if self.rows is not None:
                    grown[:start] = self.rows[:start]
                self.rows = grown
            self.rows[start:len(self)] = new
            self.fresh = []
        return self.rows

    def trim(self):
        if len(self) > self.limit:
            self.clear()
            self.rows = None


def text_chunks(texts: list, size: int = 4_000_000):
    """Consecutive runs of a batch, each of about ``size`` bytes, so that word lists stay small."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            yield start, texts[start:i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def release() -> None:
    """Hand memory that training no longer needs back to the system, where the C library can do so."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def platt(z, y) -> tuple[float, float]:
    """Slope and shift of ``sigmoid(slope * z + shift)`` as probability of label 1, with smoothed targets."""
    import numpy as np

    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, s = p - t, p * (1 - p) + 1e-3
        hess = [[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]]
        step = np.clip(np.linalg.solve(hess, [(r * z).sum() + 0.1 * (a - 1), r.sum() + 0.1 * b]), -1, 1)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(0.05, float(a)), float(b)


def isotonic(z, y, weight) -> tuple[list[float], list[float]]:
    """Knots of the best non-decreasing step function of z for the probability of label 1, ready to interpolate.

    Each block of equal probability is shrunk a little to the middle (two pseudo-rows) and gives one knot.
    """
    import numpy as np

    blocks: list[list[float]] = []  # weight, weighted label, weighted z
    for i in np.argsort(z, kind="stable"):
        blocks.append([weight[i], weight[i] * y[i], weight[i] * z[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [b[2] / b[0] for b in blocks], np.maximum.accumulate([(b[1] + 0.5) / (b[0] + 1) for b in blocks]).tolist()
