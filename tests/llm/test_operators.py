"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import chat, langid, minhash, mixing, packing, pivots, quality, queries, threshold, toxicity, urls

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def word_set(text, width=2):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(width)))) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def linked_classes(texts, width=2):
    sets, root = {d: word_set(t, width) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: find(d) for d in texts}


def check_dedup(spark, texts, more=""):
    df = spark.createDataFrame([(d, t) for d, t in texts.items()], DOC)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, width=2).collect()}
    root = linked_classes(texts)
    assert set(got) == set(texts)
    for d, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(word_set(texts[d])), root[d], root[d] == d)


def test_dedup_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_dedup(spark, docs)


def test_dedup_edges(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(120)]
    texts = {1: None, 2: "", 3: " \t\n", 4: "One", 5: "one", 6: "ÉCOLE école", 7: "École école", 8: "a b", 9: "a  B", 10: "x" * 300_000, 11: "a b c d e f", 12: "a b c d e f g"}
    for k in range(60):  # a group of near copies around a base, and chains
        t = list(base)
        for _ in range(rnd.randint(0, 8)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts[100 + k] = " ".join(t)
    check_dedup(spark, texts)


def test_dedup_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "q r s")], DOC).withColumn("fp", F.lit("x"))
    assert sorted((r.doc_id or 0, r.component_id) for r in minhash.near_duplicates(df, width=2).collect()) == [(0, 1), (1, 1), (1, 1), (2, 2)]
    assert minhash.near_duplicates(df.filter("false"), width=2).count() == 0


def test_url_rules_of_any_length(spark):
    words = ["ab", "cd", "ef", "gh", "ij"]
    rows = [(words, True)] * 60 + [([w for w in words if w != gone], False) for gone in words for _ in range(50)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = [(r.antecedent, r.confidence) for r in urls.mine_rules(labelled).collect()]
    assert got == [(words, 1.0)]


def plain_chat(rows):
    turns = defaultdict(list)
    for r in rows:
        turns[r[0]].append((r[1], r[2] or "", r[3] or ""))
    out = {}
    for c, ts in turns.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    trap = r"\### Assistant: </turn> ok"
    want = plain_chat(rows + [(-7, 0, "user", trap), (-7, 1, "assistant", trap)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op2_chat_format(spark, SF).collect()}
    assert got == want


def test_chat_round_trip(spark):
    nasty = ["", None, "\\", "\\\\", "###", "### user\n", "</turn>\n", "<\\/turn>", "a\n</turn>\n### assistant\nb", "é🙂 </ <\\/ \\#", "#" * 2000, "\\" * 2001, "x" * 300_000]
    rows = [(i, k, "assistant" if k % 2 else "us\ner: #</turn>\n", t) for i in range(2) for k, t in enumerate(nasty)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.turns_of_frame(chat.conversations(df), ["messages"]))
    got = out.select(chat.parse_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()
    for r in got:
        assert [(x.role, x.text) for x in r.t] == [(role, t or "") for i, _, role, t in rows if i == 0]
        assert r.m == "".join(t or "" for i, _, role, t in rows if i == 0 and role == "assistant")


def test_chat_layouts(spark):
    records = ['{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
               '{"prompt":"a","response":"b"}', '{"instruction":"a","output":"b"}', '{"question":"a","answer":"b"}', '{"odd":1}', "not json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, payload string")
    got = [r.turns for r in chat.turns_of_records(df, "payload").orderBy("i").collect()]
    for t in got[:5]:
        assert [(x.role, x.text) for x in t] == [("user", "a"), ("assistant", "b")]
    assert got[5:] == [None, None, None]


def test_chat_records_with_more_fields(spark):
    two = [("user", "a"), ("assistant", "b")]
    cases = [
        ('{"id":7,"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', two),
        ('{"messages":[{"role":"user","content":"a","weight":0},{"role":"assistant","content":"b","name":"x"}],"meta":{"source":["w"]}}', two),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"}]},{"role":"assistant","content":"b"}]}', two),
        ('{"messages":[{"role":"user","content":["a",{"type":"text","text":"c"},{"kind":1}]}]}', [("user", 'a\nc\n{"kind":1}')]),
        ('{"messages":[{"role":"user","content":null},{"role":"assistant"},{"content":"z"}]}', [("user", ""), ("assistant", ""), ("", "z")]),
        ('{"messages":[]}', []), ('{"messages":[],"system":"s"}', [("system", "s")]),
        ('{"system":"s","conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', [("system", "s"), *two]),
        ('{"prompt":"a","response":"b","score":0.5,"tags":["x"]}', two), ('{"input":"a","output":"b"}', two),
        ('{"context":"p","question":"q","answer":"b"}', [("user", "p\nq"), ("assistant", "b")]),
        ('{"messages":"a"}', None), ('{"messages":[1,2]}', None), ('{"odd":1}', None), ("[]", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, payload string")
    rows = chat.turns_of_records(df, "payload").orderBy("i").collect()
    assert [r.turns and [tuple(t) for t in r.turns] for r in rows] == [w for _, w in cases]
    assert len({rows[i].layout for i in (0, 1, 2, 3, 5)}) == 1 and len({rows[i].layout for i in (0, 11, 13)}) == 3
    assert chat.turns_of_records(df.filter("false"), "payload").count() == 0
    typed = spark.createDataFrame([([("user", "a", 0.5)],), (None,)], "messages array<struct<role:string,content:string,weight:double>>")
    assert sorted([tuple(t) for t in r.turns] for r in chat.turns_of_frame(typed, ["messages"]).collect()) == [[], [("user", "a")]]
    with pytest.raises(ValueError):
        chat.turns_of_frame(df, ["i"])


def plain_mined(rows, support, confidence, lift):
    """All rules by brute force: {antecedent: confidence}."""
    base = sum(bad for _, bad in rows) / len(rows)
    out = {}
    for words in {frozenset(c) for tokens, _ in rows for n in range(1, len(tokens) + 1) for c in itertools.combinations(tokens, n)}:
        hit = [bad for tokens, bad in rows if words <= set(tokens)]
        good = sum(hit) / len(hit)
        if sum(hit) / len(rows) >= support and good >= confidence and good / base >= lift:
            out[words] = good
    return out


def test_url_mining_of_templates(spark):
    """Words that always occur together are one item; verdicts equal those of all rules by brute force."""
    rng = random.Random(3)
    pool = [["a1", "a2", "a3"], ["b"], ["c1", "c2"], ["d"], ["e"]]
    rows = []
    for _ in range(200):
        picked = [g for g in pool if rng.random() < 0.5]
        rows.append((sorted(t for g in picked for t in g), "b" in [g[0] for g in picked] and rng.random() < 0.8 or rng.random() < 0.1))
    want = plain_mined([r for r in rows if r[0]], 0.05, 0.6, 1.2)
    asked = [sorted(rng.sample(["a1", "a2", "a3", "b", "c1", "c2", "d", "e", "z"], rng.randint(1, 6))) for _ in range(120)]
    rules = urls.mine_rules(spark.createDataFrame([r for r in rows if r[0]], "tokens array<string>, bad boolean"), min_support=0.05)
    got = {tuple(r.tokens): (round(r.confidence, 9), r.antecedent) for r in urls.match_rules(spark.createDataFrame([(a,) for a in asked], "tokens array<string>").distinct(), rules).collect()}
    best = {}
    for a in asked:
        fits = [(round(c, 9), -len(w), sorted(w)) for w, c in want.items() if w <= set(a)]
        if fits:
            best[tuple(a)] = (max(fits)[0], max(fits)[2])
    assert got == best and len(best) > 20
    template = [([f"w{k:02}" for k in range(40)], True)] * 50 + [(["x", f"y{i % 9}"], False) for i in range(200)]
    assert [(len(r.antecedent), len(r.classes[0]), r.confidence) for r in urls.mine_rules(spark.createDataFrame(template, "tokens array<string>, bad boolean")).collect()] == [(1, 40, 1.0)]


def test_url_rules(spark):
    from urllib.parse import urlsplit  # noqa: F401

    cases = ["http://A.Example.NET/en/1", "https://example.net/de/", "http://x.org/fr/a?b", "http://example.com/de", "http://sub.example.com/de/x", "https://notexample.com/de/x",
             "net", None, "", "ftp://h?x/y", "x://H#f", "http://a/b://c", "http://net", "http://net/", "http://internet/", "http://e.org//fr/", "://NET/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in urls.judge_urls(df, queries.URL_RULES).collect()}
    for i, u in enumerate(cases):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, after = rest[:cut].lower(), rest[cut:]
            path = after[:min([after.find(c) for c in "?#" if c in after] or [len(after)])]
        fits = [r for r in queries.URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow"), u


def test_url_mining(spark):
    rows = [(f"http://spam-{i % 3}.example.com/win/{i}", True) for i in range(60)] + [(f"http://s{i % 7}.example.com/en/{i}", i % 11 == 0) for i in range(140)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    new = spark.createDataFrame([(1, "http://spam-9.example.com/win/77"), (2, "http://s3.example.com/en/9"), (1, "http://spam-9.example.com/win/77")], "page_id long, url string")
    got = sorted((r.page_id, r.verdict) for r in urls.judge_urls(new, [], labelled).collect())
    assert got == [(1, "block"), (1, "block"), (2, "allow")]
    assert urls.judge_urls(new, [], labelled.filter("false")).filter("verdict = 'allow'").count() == 3


def held_out(spark, out, label, column):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = out.join(labels, "doc_id").filter("held_out").select(F.col(column).alias("y"), "predicted").collect()
    return got


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("x", None)] * 5)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    ask = spark.createDataFrame([(1, None), (2, ""), (3, "12 %% !"), (4, "the dog " * 50_000), (5, "— …"), (5, "und die")], DOC).withColumn("score", F.lit("old"))
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(ask, model).orderBy("doc_id", "text").collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "und")] or got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "und"), (5, "de")]
    none = langid.identify(ask, langid.train(docs.filter("false")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_language_long_without_letters(spark):
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)], "doc_id long, text string, lang string")
    texts = ["\u2014" * 134, "\U0001f642" * 100, "\u2500\u2502\n" * 100, "\u2022 12\n" * 100, "\u2026" * 5000, "\u2014" * 5000 + " dog", "\u2014" * 200 + "\u00e9"]
    ask = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = [(r.lang_pred == "und", r.score == 0, r.accepted) for r in langid.identify(ask, langid.train(docs)).orderBy("doc_id").collect()]
    assert got[:5] == [(True, True, False)] * 5
    assert [g[0] for g in got[5:]] == [False, False]


def test_kneser_ney_sums_to_one():
    words = [("a", w, 3) for w in (b"abc", b"abd", b"bcd", b"aab")] + [("b", b"ddd", 1)]
    model = langid.fit(words)
    letters = [b"a", b"b", b"c", b"d"]
    total = np.zeros(2)
    for w in letters:  # probability of each one-letter continuation after the start, and of the end
        two = langid.evaluate(model, [w])[0]
        one = [np.exp2(two[i]) for i in range(2)]
        total += one
    assert (total <= 1).all()


def test_quality_held_out(spark):
    got = held_out(spark, queries.op5_quality_fm(spark, "/root/testdata/sf0.01"), "quality", "quality")
    assert sum(r.y == r.predicted for r in got) >= 0.95 * len(got)


def test_quality_identity():
    rng = np.random.default_rng(1)
    size = quality.BUCKETS + quality.STATS
    model = quality.Model(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)), np.zeros(quality.STATS), np.ones(quality.STATS))
    f, x, s = np.array([3, 9, 70]), np.array([0.2, 0.5, 0.7]), rng.normal(size=quality.STATS)
    z, f2, x2, _ = quality._score(model, f, x, s)
    pairs = sum(model.v[f2[i]] @ model.v[f2[j]] * x2[i] * x2[j] for i in range(len(f2)) for j in range(i + 1, len(f2)))
    assert math.isclose(z, 0.3 + model.w[f2] @ x2 + pairs, rel_tol=1e-9)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_scores_edges(spark, score):
    module = quality if score is quality.score_quality else toxicity
    rows = [(i, "good words in calm prose" if i % 2 else "idiot scum !!! trash", i % 2) for i in range(120)]
    model = module.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    ask = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000), (4, "good " * 60_000), (4, "good " * 60_000)], DOC).withColumn("score", F.lit("old"))
    got = score(ask, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    empty = module.train(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert score(ask, empty).count() == 5
    assert score(ask.filter("false"), model).count() == 0


def kernel_by_hand(s, t, decay, n):
    from itertools import combinations

    def weights(x):
        out = defaultdict(float)
        for at in combinations(range(len(x)), n):
            out["".join(x[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b[k] for k, v in a.items())


def test_subsequence_kernel():
    for s, t in (("idiot", "idxiot"), ("scum", "scum"), ("trash", "thrashed"), ("abc", "xyz")):
        a, b = toxicity._codes([s], len(s), -1)[0], toxicity._codes([t], len(t), -2)[0]
        got = toxicity.subsequence_kernel(a[:, :, None] == b[:, None, :])[0]
        assert math.isclose(got, kernel_by_hand(s, t, toxicity.DECAY, 3), rel_tol=1e-4, abs_tol=1e-7)


def test_toxicity_tolerates_insertions():
    rnd = random.Random(5)
    clean = ["".join(rnd.choice("aeioubcdfghklmnprst") for _ in range(rnd.randint(3, 9))) for _ in range(900)]
    rows = [(" ".join(rnd.choices(clean, k=40)).encode(), 0) for _ in range(300)]
    rows += [(" ".join(rnd.choices(clean, k=20) + [rnd.choice(["idiot", "worthless", "pathetic"])] + rnd.choices(clean, k=20)).encode(), 1) for _ in range(200)]
    model = toxicity.fit(rows)
    kernel = toxicity.Kernel(model.landmarks)
    score = lambda t: toxicity.evaluate(model, kernel, toxicity.units(t.encode())).max()
    plain = np.quantile([score(t.decode()) for t, y in rows if not y], 0.95)
    for t in ("such an idiot", "an i d i o t here", "an i.d.i.o.t", "worth-less", "patheXtic", "IDIOT"):
        assert score(t) > plain, t


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = queries.op8_toxicity_ssk(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.toxic and r.predicted for r in got)
    assert hit >= 0.8 * sum(r.toxic for r in got) and hit >= 0.9 * sum(r.predicted for r in got)


def test_mixing_meets_targets(spark):
    rows = [(i, ("the and of " if i % 4 else "der und die ") * (1 + i % 9), "en" if i % 4 else "de") for i in range(200)] + [(900, None, None), (901, "", "en"), (902, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("tokens", F.lit("clash"))
    model = mixing.fit_posteriors(docs)
    out = mixing.mix(docs, model, {"en": 0.5, "de": 0.5}).collect()
    whole = sum(r.tokens for r in out)
    assert len(out) == 203 and whole == sum(len((t or "").split()) for _, t, _ in rows) and min(r.rate for r in out) >= 0
    for i in range(2):
        assert math.isclose(sum(r.tokens * r.posterior[i] * r.rate for r in out), whole / 2, rel_tol=0.01)
    copies = mixing.apply_rates(mixing.mix(docs, model, {"en": 0.5, "de": 0.5})).count()
    assert abs(copies - sum(r.rate for r in out)) < 40
    assert mixing.mix(docs.filter("false"), model, {"en": 1}).count() == 0


def test_mixing_keeps_unlisted_domains(spark):
    words = {"en": "the and of ", "de": "der und die ", "it": "il che di "}
    rows = [(i, words[d] * 5, d) for i, d in enumerate(["en"] * 100 + ["de"] * 60 + ["it"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = mixing.mix(docs, mixing.fit_posteriors(docs), {"en": 0.5, "de": 0.5}).collect()
    for d in words:
        assert math.isclose(sum(r.tokens * r.rate for r in out if r.lang == d), 15 * (40 if d == "it" else 80), rel_tol=0.05), d


def vectors(spark, rows, name="embedding array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, {name}")


def test_pivots_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in queries.op7_permutation_index(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit, total = hit + len(best & {v for v, _ in got[ids[i]]}), total + len(best)
        assert [s for _, s in got[ids[i]]] == sorted((s for _, s in got[ids[i]]), reverse=True)
    assert hit >= 0.9 * total


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, []), (100, [2.0, -1.0]), (1, [1.0, 1.0]), (None, [1.0, 1.0])]
    got = [(r.query_id, r.rank, r.vec_id) for r in pivots.search(vectors(spark, rows), F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 100), (0, 2, 1), (0, 3, 2), (0, 4, 20)]
    top = [(r.query_id, r.rank, r.vec_id, r.score) for r in threshold.top_k(vectors(spark, rows), F.col("id") % 100 == 0, 3).orderBy("query_id", "rank").collect()]
    assert top == [(0, 1, 100, 2 * 1024 ** 2), (0, 2, 1, 1024 ** 2), (0, 3, 2, 1024 ** 2), (100, 1, 0, 2 * 1024 ** 2), (100, 2, 1, 1024 ** 2), (100, 3, 2, 1024 ** 2)]
    assert threshold.top_k(vectors(spark, rows).filter("false"), F.col("id") % 100 == 0, 3).count() == 0
    assert pivots.search(vectors(spark, rows).filter("false"), F.col("id") % 20 == 0, 3).count() == 0


def test_threshold_exact(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.floor(1024 * np.array([r.embedding for r in rows], float)), np.array([r.vec_id for r in rows])
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in queries.op10_threshold_topk(spark, SF).orderBy("query_id", "rank").collect()]
    want = []
    for i in np.flatnonzero(ids % 100 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want += [(ids[i], k + 1, ids[j], int(s[j])) for k, j in enumerate(np.lexsort((ids, -s))[:10])]
    assert got == sorted(want)


def pack_is_valid(docs, pieces, slack=1.02):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer_path())
    want = defaultdict(list)
    for d in docs:
        ids = np.array(coder.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        n = len(ids)
        first = n if n <= 1024 else n % 1024 or 1024
        cuts = [(0, first)] + [(s, 1024) for s in range(first, n, 1024)]
        want[d.doc_id] += [(i, s, k, zlib.crc32(ids[s:s + k].tobytes())) for i, (s, k) in enumerate(cuts)]
    got, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p.doc_id].append((p.piece, p.start, p.length, p.ids_crc32))
        places[p.sequence_id].append((p.offset, p.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for v in places.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 1024
    assert len(places) <= max(2, slack * math.ceil(sum(p.length for p in pieces) / 1024))


def test_packing_edges(spark):
    texts = [None, "", " ", "  ", "a  b", "a \n b", "a\n b", "tail ", "tail\n ", " lead", "x<|endoftext|>y <|endoftext|> z", "don't  stop\t\there", "é🙂 \u00a0 \u2003x", "word " * 30_000, "q" * 20_000, "a\n\n b  \n c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "  ")], DOC).withColumn("piece", F.lit("clash"))
    pack_is_valid(docs.collect(), packing.pack(docs, queries.tokenizer_path()).collect())
    assert packing.pack(docs.filter("false"), queries.tokenizer_path()).count() == 0


def test_packing_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    pack_is_valid(docs.collect(), queries.op9_best_fit_packing(spark, SF).collect())


def test_bin_completion():
    rnd = random.Random(2)
    assert len(packing.complete([6, 6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 2, 2, 2, 2], 20)) == 4
    for _ in range(40):
        lengths = [rnd.randint(1, 60) for _ in range(rnd.randint(0, 40))]
        bins = packing.complete(lengths, 100, 3000)
        assert sorted(n for b in bins for n in b) == sorted(lengths) and all(sum(b) <= 100 for b in bins)
        assert len(bins) <= len(packing.best_fit(sorted(lengths, reverse=True), 100))
    assert len(packing.complete([51, 27, 26, 23, 23] * 2, 100)) <= 4


def test_dedup_of_five_words_and_of_rows_without_ids(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = spark.createDataFrame(list(docs.items()), DOC)
    root = linked_classes(docs, 5)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == root
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(900)}" for _ in range(300)]
    chain = [" ".join(base[:k * 12] + [f"x{i}" for i in range(k * 12)] + base[k * 12:]) for k in range(3)]
    rows = [(None, chain[0]), (None, chain[1]), (5, chain[2]), (None, "alone of its kind here"), (7, None), (None, None)]
    sets = [word_set(t, 2) for t in chain]
    assert all(100 * len(a & b) >= 80 * len(a | b) for a, b in zip(sets, sets[1:]))
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC), width=2).collect()))
    want = sorted([(0, len(sets[0]), 5), (0, len(sets[1]), 5), (5, len(sets[2]), 5), (0, 4, 0), (7, 0, 7), (0, 0, 0)])
    assert got == want


def test_bin_completion_reaches_the_optimum_of_small_sets():
    def optimum(lengths, size):
        best, order = [len(lengths)], sorted(lengths, reverse=True)

        def go(i, bins):
            if len(bins) < best[0]:
                if i == len(order):
                    best[0] = len(bins)
                    return
                for k in range(len(bins)):
                    if bins[k] + order[i] <= size and bins[k] not in bins[:k]:
                        go(i + 1, [*bins[:k], bins[k] + order[i], *bins[k + 1:]])
                go(i + 1, [*bins, order[i]])

        go(0, [])
        return best[0]

    rnd = random.Random(1)
    for _ in range(200):
        size = rnd.choice([10, 30, 100])
        lengths = [rnd.randint(1, size) for _ in range(rnd.randint(1, 10))]
        bins = packing.complete(lengths, size)
        assert sorted(n for b in bins for n in b) == sorted(lengths) and max(map(sum, bins)) <= size
        assert len(bins) == optimum(lengths, size)
    many = [rnd.choice([150, 200, 333, 340, 345, 260, 270, 512, 500]) for _ in range(2000)]
    best_fit = packing.best_fit(sorted(many, reverse=True), 1024)
    assert len(packing.complete(many, 1024)) < len(best_fit)  # here the search finds what best fit misses


def test_coder_gives_the_ids_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    coder, whole = packing.Coder(path), Tokenizer.from_file(path)
    rnd = random.Random(0)
    bits = ["a", "the", "Über", "é", " ", " ", " ", "\n", "\n\n", ".", ",", "***", "'s", "'", "1", "23", "_", "²", "́", "中", "\t", "\r", "🙂", "\xa0", "\u2028", "\x1c", "-", "can't", "<|endoftext|>", "\u180e", "\U0001e900", "\ua7cb", "\U00016d40", "ſ", "\x85", "\u0600", "٣", "Ⅷ"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(8000)]
    for text, ids in zip(texts, coder(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert coder.fast and coder.rare  # both ways were taken
    assert packing.Coder(public_tokenizers.path("word_bpe_49k.json")).fast is None
    long = [" " * 3_000_000 + "x", "\n \t" * 500_000, "b" * 200_000, "!" * 200_000, "", " "]
    assert [np.frombuffer(i, "<u4").tolist() for i in coder(long)] == [whole.encode(t, add_special_tokens=False).ids for t in long]


def test_coder_on_the_whole_vocabulary():
    """Every token as a text of its own and beside every other kind of neighbour."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    coder, whole = packing.Coder(path), Tokenizer.from_file(path)
    tokens = [whole.decode([i]) for i in range(whole.get_vocab_size())]
    rnd = random.Random(5)
    texts = tokens + ["".join(rnd.choices(tokens, k=6)) for _ in range(40000)]
    for text, ids, same in zip(texts, coder(texts), whole.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == same.ids, repr(text)
