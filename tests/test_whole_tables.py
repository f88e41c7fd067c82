"""Queries over whole tables where their SQL twins read a part."""

from collections import Counter

from catalog import detection as D, streams as S
from tests.conftest import SF
from veilframe.operators import context


def test_time_outs_of_all_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn").distinct().collect()
    want = Counter(str(r.conv_id) for r in rows)
    assert any(int(s) % 2 for s in want)
    assert {r.stream_id: r.blocks for r in S.stream_timeout_all(spark, SF).collect()} == want


def test_all_learned_values(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has one text a session
    docs, found = D.session_entities(spark, sf)
    learned, want = context.learn_entities(found).collect(), Counter()
    assert any(not r.value.startswith("RM-") for r in learned)
    for d in docs.collect():
        known = sorted((r.value for r in learned if r.session == d.session and r.first_seq < d.seq), key=len, reverse=True)
        at = 0
        while at < len(d.text):
            hit = next((v for v in known if d.text.startswith(v, at)), None)
            want[d.doc_id, hit] += hit is not None
            at += len(hit) if hit else 1
    want = {k: n for k, n in want.items() if n}
    got = {(r.doc_id, r.value): r.n for r in D.learned_propagation_all(spark, sf).collect()}
    assert any(not v.startswith("RM-") for _, v in got)
    assert got == want
