"""Null ids, dictionary restore under all rules, literal matching, and payloads without loss."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.keyed import Keys
from veilframe.operators import literals
from veilframe.operators.payload import explode_messages, reassemble_messages, string_places
from veilframe.operators.restore import restore, restore_with_stats
from veilframe.plans.obfuscate import Config, obfuscate

TEXT = "tenant string, doc_id bigint, text string"


def test_null_ids_never_leak(spark):
    rows = [("", None, "mine 123-45-6789 end"), ("", 2, "call 123-45-6789"), ("", None, "other 987-65-4321"), ("b", 2, "x 222-33-4444 y"), ("b", None, None)]
    docs = spark.createDataFrame(rows, TEXT)
    result = obfuscate(docs, Config(Keys("secret", "salt")))
    out = result.docs.collect()
    assert sorted(map(str, ((r.tenant, r.doc_id, r.text) for r in out))) == sorted(map(str, rows))
    fakes = {(r.tenant, r.real): r.fake for r in result.mapping.collect()}
    for r in out:
        want = r.text
        for (tenant, real), fake in fakes.items():
            want = want.replace(real, fake) if want and tenant == r.tenant else want
        assert r.text_out == want and (r.text is None or r.text_out != r.text)
    derived = result.docs.select("tenant", "doc_id", F.col("text_out").alias("text"))
    assert sorted(map(str, ((r.tenant, r.doc_id, r.text_out) for r in restore(derived, result.mapping).collect()))) == sorted(map(str, rows))
    texts, counts = restore_with_stats(derived, result.mapping)
    assert sorted(str(r.text_out) for r in texts.collect()) == sorted(str(t) for *_, t in rows)
    assert sorted((str(r.doc_id), r.replacements) for r in counts.collect()) == [("2", 1), ("2", 1), ("None", 1), ("None", 1)]


def test_stand_ins_differ_from_what_texts_keep(spark):
    texts = [f"vlan {n}\nbatch {2 * n} of {3 * n}, notice{5 * n}@x" for n in range(100, 160)] + ["the numbers " + " ".join(str(n) for n in range(1, 1500))]
    docs = spark.createDataFrame([("", i, t) for i, t in enumerate(texts)], TEXT)
    result = obfuscate(docs, Config(Keys("secret", "salt")))
    assert result.entities.count() >= 60
    back = restore(result.docs.select("tenant", "doc_id", F.col("text_out").alias("text")), result.mapping).collect()
    assert {r.doc_id: r.text_out for r in back} == dict(enumerate(texts))


@pytest.mark.parametrize("whole", [False, True])
def test_automaton_and_joins_agree(spark, whole, monkeypatch):
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("ab1 2é.𝒳") for _ in range(n))
    docs = spark.createDataFrame([("t" if i % 2 else "u", i, some(rnd.randint(0, 60))) for i in range(200)] + [("t", 999, None)], TEXT)
    lits = spark.createDataFrame(list({(rnd.choice("tu"), some(rnd.randint(1, 9))) for _ in range(150)}) + [("t", ""), ("t", None)], "tenant string, literal string").distinct()
    found = lambda: sorted(map(tuple, literals.match_literals(docs, lits, by=("tenant",), whole=whole).select("doc_id", "tenant", "start", "end", "value").collect()))
    one = found()
    monkeypatch.setattr(literals, "AUTOMATON_LITERALS", 0)
    assert found() == one and len(one) > 100
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[d][s:e] == v for d, _, s, e, v in one)
    if whole:
        assert not any(s and texts[d][s - 1].isdecimal() and v[0].isdecimal() for d, _, s, _, v in one)


def test_payloads_come_back_byte_for_byte(spark):
    rows = [
        '{"model":"m","messages":[{"role":"user","content":"hi \\u00e9 \\"x\\""},{"role":"user","content":[{"type":"tool_result","content":"r1","n":1.0},{"type":"text","text":"t1"}]}]}',
        ' { "system" : "be brief" , "messages" : [ ] , "x" : [1, 2.50, {"text":"no"}] } ',
        '{"messages":[{"role":"assistant","content":null,"tool_calls":[{"id":"a","function":{"name":"f","arguments":"{\\"q\\": \\"v\\"}"}}]}],"unknown":{"deep":[[{"k":"é"}]]}}',
        '{"contents":[{"role":"model","parts":[{"text":"p1"},{"data":1},{"text":"p2"}]}],"system_instruction":{"parts":[{"text":"s"}]},"instructions":"go"}',
        '{"input":[{"role":"user","content":"in"}],"messages":[]}', "{broken", "[]", '"text"', "{}", None, '{"messages":[{"role":"user","content":"one"}]} trailing',
    ]
    payloads = spark.createDataFrame(list(enumerate(rows)), "msg_id int, payload string")
    leaves = explode_messages(payloads)
    same = {r.msg_id: r.payload for r in reassemble_messages(leaves, payloads=payloads).collect()}
    assert same == dict(enumerate(rows))
    changed = {r.msg_id: r.payload for r in reassemble_messages(leaves.withColumn("text", F.concat("text", F.lit('"\n!'))), payloads=payloads).collect()}
    assert changed[0] == rows[0].replace('hi \\u00e9 \\"x\\"', 'hi é \\"x\\"\\"\\n!').replace('"r1"', '"r1\\"\\n!"').replace('"t1"', '"t1\\"\\n!"')
    assert changed[3] == rows[3].replace('"p1"', '"p1\\"\\n!"').replace('"p2"', '"p2\\"\\n!"').replace('"s"', '"s\\"\\n!"').replace('"go"', '"go\\"\\n!"')
    assert json.loads(changed[2])["messages"][0]["tool_calls"][0]["function"]["arguments"] == '{"q": "v"}"\n!'
    assert json.loads(changed[2])["unknown"] == json.loads(rows[2])["unknown"] and changed[5] == rows[5]


def test_string_places_name_every_string():
    rnd = random.Random(2)

    def make(depth):
        kind = rnd.randint(0, 5 if depth else 2)
        return rnd.choice(["a", 'q"\\', "é\n", ""]) if kind < 2 else rnd.choice([1, -2.5, True, None]) if kind == 2 else (
            [make(depth - 1) for _ in range(rnd.randint(0, 3))] if kind == 3 else {f"k{i}": make(depth - 1) for i in range(rnd.randint(0, 3))})

    def leaves(v, path):
        if isinstance(v, str):
            yield path, v
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from leaves(x, (f"{path}.{k}" if path else k) if isinstance(v, dict) else f"{path}[{k}]")

    for _ in range(400):
        v = make(4)
        text = json.dumps(v, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1]))
        got = list(string_places(text))
        assert [(p, x) for p, _, _, x in got] == list(leaves(v, "")) and all(json.loads(text[a:b]) == x for _, a, b, x in got)


def test_range_descriptions(spark):
    """Against a plain count of addresses, block by block; what is no description is left alone."""
    from veilframe.operators import subnets as S

    base = S.POOL_BASE
    blocks = [("a", 10 * 2**24, 14, base), ("a", 172 * 2**24 + 16 * 2**16, 24, base + 2**18), ("a", 192 * 2**24 + 168 * 2**16, 26, base + 2**18 + 256),
              ("a", 192 * 2**24 + 169 * 2**16, 25, base + 2**18 + 384), ("b", 20 * 2**24, 24, S.SPILL_BASE), ("b", 30 * 2**24, 24, None)]
    subnets = spark.createDataFrame(blocks, "tenant string, real_net bigint, prefix_len int, fake_net bigint")
    expected = {
        "100.64.3.x/24": "10.0.3.x/24", "100.66.x.x": "10.2.x.x", "100.68.0.x": "172.16.0.x", "100.68.1.X/xx": "192.169.1.X/xx", "100.68.0-1.x": "172.16.0-1.x",
        "100.68.1.0-70": "192.168.1.0-70", "100.68.1.120-255": "192.169.1.120-255", "100.64.0.0/10": "10.0.0.0/16", "100.65": "10.1", "100.67/12": "10.0/16",
        "100.127.9.x": "10.0.9.x", "100.64.3.7": None, "100.64.3.0/24": None, "100.64.300.x": None, "100.64.9-3.x": None, "100.64.3.x/40": None}
    found = spark.createDataFrame([(t, i, v) for t in "ab" for i, v in enumerate(expected)], "tenant string, doc_id bigint, value string")
    got = {(r.tenant, r.value): r.repl for r in S.residual_ranges(found, subnets).collect()}
    assert got == {("a", v): r for v, r in expected.items() if r is not None}
    assert S.residual_ranges(found, subnets.limit(0)).count() == 0
