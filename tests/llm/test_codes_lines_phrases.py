"""Vector codes, line frequency and phrase mining against brute force, with odd rows of every kind."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import codes, lines, phrases, queries

VEC = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """{row number: (code, error)}, final entries: every part compared with every entry in Python integers."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(c is not None and np.isfinite(np.float32(c)) for c in r[1])]
    xs = [[int(np.floor(256 * float(np.float32(c)))) for c in r[1]] for _, r in kept]
    w = len(xs[0]) // parts
    seeds = sorted((r[0], x) for (_, r), x in zip(kept, xs) if r[0] is not None)[:entries]
    book = [[x[p * w:(p + 1) * w] for _, x in seeds] for p in range(parts)]

    def assign(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x[p * w:(p + 1) * w], e)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        sums = defaultdict(list)
        for x in xs:
            for p in range(parts):
                sums[p, assign(x, p)[1]].append(x[p * w:(p + 1) * w])
        for (p, k), found in sums.items():
            book[p][k] = [sum(c) // len(found) for c in zip(*found)]
    out = {}
    for (i, _), x in zip(kept, xs):
        pairs = [assign(x, p) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for _, k in pairs), sum(d for d, _ in pairs)
    return out, book


@pytest.mark.parametrize("seed,n,dim,spread", [(0, 300, 32, 1.0), (1, 40, 16, 1.0), (2, 200, 16, 0.01)])
def test_codes_equal_brute_force(spark, seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(c) for c in rng.normal(0, spread, dim)], int(i % 3)) for i in rng.permutation(n)]
    rows += [rows[0], (5, None, 1), (6, [None] * dim, 1), (7, [float("nan")] * dim, 2), (8, [float("inf")] + [0.0] * (dim - 1), None), (None, [0.5] * dim, None), (9000, [0.0] * dim, None)]
    df = spark.createDataFrame(rows, VEC).withColumn("id", F.lit("clash")).withColumn("x", F.lit(1)).withColumn("code", F.lit(2))
    want, book = plain_codes(rows)
    coded, got = codes.compress(df)
    assert got.entries.transpose(0, 1, 2).tolist() == book
    assert got.digest() == hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    assert Counter((r.vec_id, r.code, r.error) for r in coded.collect()) == Counter((rows[i][0], *v) for i, v in want.items())
    by = Counter()
    for i, (_, e) in want.items():
        by[rows[i][2]] += e
    assert {(r.label, r.label_error) for r in codes.with_group_error(coded).collect()} == set(by.items())


def test_search_equals_scan_with_ties_and_equal_entries():
    rng = np.random.default_rng(3)
    for trial in range(20):
        book = rng.integers(-3, 4, (2, int(rng.integers(1, 65)), int(rng.integers(1, 5))))
        x = rng.integers(-4, 5, (500, 2 * book.shape[2]))
        c, d = codes.Codebook(book).assign(x)
        for p in range(2):
            far = ((x.reshape(500, 2, -1)[:, p][:, None] - book[p][None]) ** 2).sum(-1)
            assert (far.argmin(1) == c[:, p]).all() and (far.min(1) == d[:, p]).all()


def test_codes_of_no_vectors_and_of_bad_ones(spark):
    for rows in ([], [(1, None, 0)]):
        coded, book = codes.compress(spark.createDataFrame(rows, VEC))
        assert book is None and codes.with_group_error(coded).collect() == []
    with pytest.raises(Exception, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 17, 0)], VEC))
    with pytest.raises(Exception, match="below"):
        codes.compress(spark.createDataFrame([(1, [3e30] * 16, 0)], VEC))


WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_lines(rows, limit, keep=50):
    """What ``line_verdicts`` returns, row by row."""
    seen = defaultdict(set)
    cut = []
    for i, (_, text, host) in enumerate(rows):
        t = text or ""
        norm = [(" ".join(WORD.findall(x)).lower(), x, len(WORD.findall(x))) for x in t.split("\n") if WORD.search(x)]
        cut.append(norm)
        for key, _, _ in norm:
            seen[host, key].add(i)
    out = []
    for (d, text, host), norm in zip(rows, cut):
        t = text or ""
        w = WORD.findall(t)
        found = Counter(zip(w, w[1:], w[2:]))
        repeat = {p for i, x in enumerate(zip(w, w[1:], w[2:])) if found[x] > 1 for p in (i, i + 1, i + 2)}
        gone = [n for key, _, n in norm if len(seen[host, key]) > limit]
        base = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(norm) - len({x for _, x, _ in norm}), len(repeat), base,
                    len(norm), len(gone), sum(gone), not base and 100 * (len(w) - sum(gone)) >= keep * len(w)))
    return out


def odd_documents(rng):
    words = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, "\n".join([some(40), "Shared  LINE of the host", some(30), "again", "again", "a b c a b c"]), f"h{i % 2}") for i in range(20)]
    shared = "all of these " + " ".join(rng.permutation(words)[:90])
    rows += [(100 + i, f"{shared}\n{some(20)}", "h0") for i in range(12)]
    rows += [(3, some(60), None), (3, some(60), None), (None, "same\n" * 3 + some(80), "h1"), (None, None, None), (50, None, "h0"), (51, "", "h0"), (52, " \t\n\x0b\x0c\r\n", "h0"),
             (53, "é# ü$ 中<> 𝒳|x y", "h1"), (54, some(60000), "h1"), (55, "x " * 3000, ""), (56, "shared line\tof the host\n" + some(50), "h0")]
    return rows + rows[:2]


def test_lines_equal_brute_force(spark):
    rows = odd_documents(np.random.default_rng(5))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumns({c: F.lit(1) for c in ("words", "rows", "h", "n", "lines", "removed", "kept", "__row", "windows", "n_words", "raw_lines")})
    for limit in (5, 11, 1000):
        got = lines.line_verdicts(df, limit=limit).drop("removed").collect()
        assert Counter(map(tuple, got)) == Counter(plain_lines(rows, limit))
    assert any(r[8] for r in plain_lines(rows, 5)) and not all(r[10] for r in plain_lines(rows, 5) if not r[6])


def test_lines_removed_from_texts(spark):
    rows = [(i, f"Own text number {i} " + "of some words " * 9 + "\nShared  LINE\n\nend %d" % i, "h") for i in range(9)] + [(99, None, "h"), (7, "shared line", "other")]
    got = {(r.doc_id, r.source): r.text_out for r in lines.strip_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), limit=5).collect()}
    assert got == {(d, s): t if t is None or s != "h" else t.replace("\nShared  LINE", "") for d, t, s in rows}


def test_lines_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lines.line_verdicts(empty).collect() == [] and lines.strip_frequent_lines(empty).collect() == []


def plain_phrases(rows, least, top, longest=4, cover=80):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + n])) for i in range(len(w) - n + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = {(lang, p[i:j]) for (lang, p), a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= cover * f[lang, p[i:j]]}
    by = defaultdict(list)
    for (lang, p), a in cand.items():
        if (lang, p) not in covered:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, x, y, total[lang], -s) for lang, found in by.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}


def odd_texts(rng):
    words = ["The", "of", "new", "york", "City", "é", "中", "a b", "𝒳", "state", "bank", "river"]
    some = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", " , ", "\n", " ", " ", " "]) for _ in range(n))
    rows = [(some(120), str(rng.choice(["en", "de"]))) for _ in range(40)] + [("New York City hall", "en")] * 40 + [("new york", None)] * 35
    return rows + [(None, "en"), ("", "fr"), ("   ", "fr"), (None, None), (some(30000), "en"), ("x" * 5000, "de"), ("q " * 9000, "xx")]


@pytest.mark.parametrize("block", [4_000_000, 700])
def test_phrases_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows = odd_texts(np.random.default_rng(8))
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("block", "words", "n", "phrase", "doc_id")})
    got = {tuple(r) for r in phrases.collocations(df, top=40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == plain_phrases(rows, 30, 40)


def test_blocks_keep_pieces_whole(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 50)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"ab .\t,"), int(n))) for n in rng.integers(0, 400, 60)] + [b"x" * 500, b"", b"y " * 200 + b"." + b"z"]
    pieces = lambda data: [p.split() for p in data.translate(phrases.MAP).split(b"\n") if p.split()]
    assert [p for b in phrases.blocks_of(texts) for p in pieces(b)] == [p for t in texts for p in pieces(t)]


def test_fingerprints_that_collide_are_told_apart_by_words():
    numbers = np.array([1, 2, 0, 3, 4, 0, 1, 2], np.int32)
    start, count = phrases.same_words(numbers, np.array([0, 3, 6]), np.array([7, 7, 7], np.uint64), 2)
    assert sorted(zip(numbers[start].tolist(), count.tolist())) == [(1, 2), (3, 1)]


def test_shards_add_up_capped_counts():
    values, counts = np.array([0, 5, 2**31, 2**32 - 1], np.uint32), np.array([1, 30, 2, 7])
    got = phrases.unpack(phrases.pack(values, counts))
    assert (got[0] == values).all() and (got[1] == counts).all()


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_large_totals_are_exact(spark):
    row = spark.range(1).selectExpr("(cast(2000000 as decimal(7,0)) * cast(9000000000000000000 as decimal(20,0))) div (cast(9000000000000000001 as decimal(20,0)) + cast(9000000000000000003 as decimal(20,0))) as s").first()
    assert row.s == 2_000_000 * 9000000000000000000 // (9000000000000000001 + 9000000000000000003)


def test_new_queries_are_registered_with_sql():
    names = {"op11_orchard_codes", "op12_line_frequency", "op13_phrase_mining"}
    assert names <= set(queries.QUERIES) and names <= set(queries.ORACLES)
