"""Whole jobs: round trips, uniqueness, determinism, tenants, subnets, audit, streams."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from veilframe.functions import ip
from veilframe.functions.keyed import Keys
from veilframe.operators import audit, checks, mapping as M, restore as B, rules as R, subnets as S
from veilframe.plans.obfuscate import Config, obfuscate, process_batch
from veilframe.sources import readers
from veilframe.session import materialize
from tests.test_detection import EXAMPLES

KEYS = Keys("k", "s")


def as_text(df, col="text_out"):
    return df.select("tenant", "doc_id", F.col(col).alias("text"))


def test_round_trip_and_nothing_visible(spark, docs_of):
    docs = docs_of(*[t for t, _, _ in EXAMPLES], "nothing here")
    r = obfuscate(docs, Config(KEYS))
    out = materialize(r.docs, "t")
    values = {(x.doc_id, x.value) for x in r.entities.collect()}
    texts = {x.doc_id: x.text_out for x in out.collect()}
    assert not [(d, v) for d, v in values if v in texts[d]]
    back = B.restore(as_text(out), r.mapping)
    assert checks.roundtrip_errors(docs, as_text(back)).count() == 0
    exact = B.restore_exact(out, r.entities)
    assert checks.roundtrip_errors(docs, as_text(exact, "text_restored")).count() == 0
    assert r.mapping.count() == r.mapping.select("fake").distinct().count()
    assert texts[len(EXAMPLES)] == "nothing here"


def test_same_key_same_fakes_other_key_other_fakes(docs_of):
    docs = docs_of("mail bob@acme.com and 10.1.2.3 and 123-45-6789")
    def run(keys, d=docs):
        return {x.real: x.fake for x in obfuscate(d, Config(keys, R.family("core"), context=False, code=False)).mapping.collect()}
    one = run(KEYS)
    assert one == run(KEYS)
    other = run(Keys("k", "other"))
    assert one["123-45-6789"] != other["123-45-6789"] and one["bob@acme.com"] != other["bob@acme.com"]


def test_tenants_are_apart(spark):
    docs = spark.createDataFrame([("a", 1, "ssn 123-45-6789"), ("b", 2, "ssn 123-45-6789")], "tenant string, doc_id bigint, text string")
    m = obfuscate(docs, Config(KEYS, R.named("ssn"), context=False, code=False)).mapping.collect()
    assert {x.tenant for x in m} == {"a", "b"} and len({x.fake for x in m}) == 2


def test_store_keeps_its_stand_ins(docs_of, spark):
    config = Config(KEYS, R.named("ssn"), context=False, code=False)
    first = materialize(obfuscate(docs_of("ssn 123-45-6789"), config).mapping, "m")
    changed = first.withColumn("fake", F.lit("999-99-9999"))
    second = obfuscate(docs_of("ssn 123-45-6789 ssn 222-33-4444"), config, changed)
    text = second.docs.first().text_out
    assert "999-99-9999" in text and "222-33-4444" not in text
    again = obfuscate(as_text(second.docs), config, second.mapping)
    assert again.docs.first().text_out == text  # stand-ins are not replaced again
    assert again.judged.filter("drop_reason = 'already_obfuscated'").count() == 2


def test_levels_and_dry_run(docs_of):
    docs = docs_of("mail bob.smith@acme.com, again bob.smith@acme.com")
    rules = R.named("email")
    def text(**kw):
        return obfuscate(docs, Config(KEYS, rules, context=False, code=False, **kw)).docs.first().text_out
    assert text(level="masked") == "mail b***@***.com, again b***@***.com"
    assert text(level="stats") == "mail [EMAIL-1], again [EMAIL-2]"
    assert text(dry_run=True) == "mail bob.smith@acme.com, again bob.smith@acme.com"
    with pytest.raises(ValueError):
        Config(KEYS, level="other")


def test_filters_in_a_job(docs_of):
    docs = docs_of("bob@acme.com 10.1.2.3 123-45-6789 HIDE")
    r = obfuscate(docs, Config(KEYS, R.family("core"), allowlist=("10.*",), exempt=("ssn",), denylist=("HIDE",), context=False, code=False,
                               custom_patterns=({"name": "c", "pattern": "acme"},)))
    s = r.stats.first()
    assert (s.allowlisted, s.exempted, s.replaced) == (1, 1, 2)
    out = r.docs.first().text_out
    assert "10.1.2.3" in out and "123-45-6789" in out and "HIDE" not in out and "bob@acme.com" not in out


def test_extensions(docs_of, spark):
    def shout(docs):
        return docs.filter("text like '%LOUD%'").select("tenant", "doc_id", F.lit("LOUD").alias("value"), (F.instr("text", "LOUD") - 1).alias("start"),
                                                        (F.instr("text", "LOUD") + 3).alias("end"), F.lit("shout").alias("category"), F.lit(1.0).alias("confidence"), F.lit("custom:shout").alias("detector"))
    config = Config(KEYS, R.named("ssn"), context=False, code=False).register_detector(shout).register_generator("shout", "concat('calm-', substring(h, 1, 4))")
    assert "calm-" in obfuscate(docs_of("be LOUD 123-45-6789"), config).docs.first().text_out


def test_small_pools_still_give_unique_stand_ins(spark):
    n = 400
    values = spark.createDataFrame([("", f"Town {i}", "location", i) for i in range(n)] + [("", str(100 + i), "vlan_id", i) for i in range(n)],
                                   "tenant string, value string, category string, first_seen bigint")
    m = M.fix_collisions(M.mint(values, KEYS, categories=["location", "vlan_id"])[0], KEYS)
    assert m.count() == 2 * n == m.select("fake").distinct().count()
    assert m.filter("fake = real").count() == 0


def test_luhn_of_fake_cards(spark):
    values = spark.createDataFrame([("", f"4{i:015d}", "credit_card") for i in range(200)], "tenant string, value string, category string")
    for row in M.mint(values, KEYS, categories=["credit_card"])[0].collect():
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, row.fake)))
        assert len(row.fake) == 16 and total % 10 == 0


def test_formats_survive(spark):
    cases = [("web-01.prod.acme.net", "hostname", r"^[a-z]+-\d\d\.prod\.[a-z]+\.net$"), ("CHI-CORE-RTR-01", "hostname", r"^[A-Z]{3}-CORE-RTR-\d\d$"),
             ("a.b@mail.acme.co.uk", "email", r"^[a-z]+\.[a-z]+\d*@[a-z]+\.uk$"), ("00-1a-2b-3c-4d-5e", "mac_address", r"^([0-9a-f]{2}-){5}[0-9a-f]{2}$"),
             ("+44 20 7946 0958", "phone", r"^\+44 \d{3} \d{3} \d{4}$"), ("03/15/87", "date_of_birth", r"^\d\d/\d\d/\d\d$"),
             ("15.03.1987", "date_of_birth", r"^\d\d\.\d\d\.\d{4}$"), ("March 3, 1987", "date_of_birth", r"^[A-Z][a-z]+ \d+, \d{4}$"),
             ("C:\\a\\b.txt", "file_path", r"^[a-z]+\\[a-z]+\\[a-z]+\.txt$"), ("UPLINK TO CHI-SW-01", "interface_desc", r"^UPLINK TO [A-Z]{3}-SW-\d\d$"),
             ("https://admin.x1.acme.com:8443/a/b", "url", r"^https://admin\.[a-z0-9]+\.[a-z]+\.com:8443/\w+/\w+$"),
             ("-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "certificate", r"^-----BEGIN TEST KEY-----\n"),
             ("Plant.Area.Tag", "ics_identifier", r"^\w+\.\w+\.\w+$"), ("王伟 李", "person_name", r"^\w+ \w+$"), ("12 O 456/23", "case_number", r"^\d\d O \d{3}/\d\d$")]
    values = spark.createDataFrame([("", v, c) for v, c, _ in cases], "tenant string, value string, category string")
    fakes = {r.real: r.fake for r in M.mint(values, KEYS)[0].collect()}
    import re

    assert [(v, fakes[v]) for v, _, p in cases if not re.match(p, fakes[v])] == []
    assert all(fakes[v] != v for v, _, _ in cases)


def test_neighbour_asns_stay_neighbours(spark):
    values = spark.createDataFrame([("", str(n), "bgp_asn") for n in (64600, 64601, 64602, 3320, 3321)], "tenant string, value string, category string")
    f = {r.real: int(r.fake) for r in M.mint(values, KEYS, categories=["bgp_asn"])[0].collect()}
    assert f["64601"] - f["64600"] == 1 and f["64602"] - f["64601"] == 1 and f["3321"] - f["3320"] == 1
    assert all(64512 <= f[k] <= 65534 for k in ("64600", "64601", "64602")) and len(set(f.values())) == 5


def subnet_rows(spark, rows):
    return spark.createDataFrame([("", *r) for r in rows], "tenant string, real_net bigint, prefix_len int")


@pytest.mark.parametrize("limit", [10**6, 0])
def test_blocks_do_not_overlap(spark, limit, monkeypatch):
    monkeypatch.setattr(S, "WINDOW_ROWS", limit)
    rows = [(10 * 2**24 + i * 2**16, 16) for i in range(70)] + [(192 * 2**24 + i * 256, 24) for i in range(40)] + [(11 * 2**24, 8), (9 * 2**24 + 64, 28)]
    first = materialize(S.allocate_subnets(subnet_rows(spark, rows)), "a")
    both = S.allocate_subnets(subnet_rows(spark, rows + [(12 * 2**24, 24), (13 * 2**24, 20)]), first).collect()
    assert {(r.real_net, r.fake_net) for r in first.collect()} <= {(r.real_net, r.fake_net) for r in both}
    blocks = sorted((r.fake_net, r.fake_net + 2 ** (32 - r.prefix_len)) for r in both)
    assert len(both) == len(rows) + 2 and all(a[1] <= b[0] for a, b in zip(blocks, blocks[1:]))
    assert all(r.fake_net % 2 ** (32 - r.prefix_len) == 0 for r in both)


def test_longest_prefix_and_residual(spark, docs_of):
    docs = docs_of("net 10.1.0.0/16 and 10.1.2.0/24 and 10.9.9.1 255.255.255.252 and 10.7.7.1 0.0.0.255")
    known = S.learn_subnets(docs)
    assert {(r.prefix_len) for r in known.collect()} == {16, 24, 30}
    ips = spark.createDataFrame([("", "10.1.2.3"), ("", "10.1.9.9"), ("", "8.8.8.8")], "tenant string, value string")
    got = {r.value: r.prefix_len for r in S.prefix_len(ips, known).collect()}
    assert got == {"10.1.2.3": 24, "10.1.9.9": 16, "8.8.8.8": 24}
    blocks = materialize(S.allocate_subnets(known), "b")
    fake = blocks.filter("prefix_len = 24 and real_net = 167838208").first().fake_net
    asked = spark.createDataFrame([("", ".".join(str(fake + 77 >> s & 255) for s in (24, 16, 8, 0)))], "tenant string, value string")
    assert S.residual_v4(asked, blocks).first().repl == "10.1.2.77"


def test_later_batches_use_earlier_prefixes(spark):
    first = materialize(S.allocate_subnets(subnet_rows(spark, [(10 * 2**24 + 2**16, 16), (10 * 2**24 + 2**16 + 512, 24)])), "first")
    values = spark.createDataFrame([("", v, "ip_address") for v in ("10.1.9.9", "10.1.2.7", "10.7.7.7")], "tenant string, value string, category string")
    fresh = subnet_rows(spark, [(10 * 2**24 + 2**16, 30), (10 * 2**24 + 7 * 2**16, 16)])
    minted, subnets = M.mint(values, KEYS, fresh, first, ["ip_address"])
    fake = {r.real: r.fake for r in minted.collect()}
    block = {(r.real_net, r.prefix_len): r.fake_net for r in subnets.collect()}
    dotted = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    assert fake["10.1.9.9"] == dotted(block[10 * 2**24 + 2**16, 16] + 9 * 256 + 9)
    assert fake["10.1.2.7"] == dotted(block[10 * 2**24 + 2**16 + 512, 24] + 7)
    assert fake["10.7.7.7"] == dotted(block[10 * 2**24 + 7 * 2**16, 16] + 7 * 256 + 7)
    assert {(r.real_net, r.prefix_len, r.fake_net) for r in first.collect()} <= {(*k, v) for k, v in block.items()}


def test_more_subnets_than_space(spark):
    nets = spark.range(2_000_000).selectExpr("'' tenant", "id * 256 real_net", "24 prefix_len")
    got = S.allocate_subnets(nets).agg(F.count(F.lit(1)), F.count("fake_net"), F.countDistinct("fake_net"), F.max("fake_net")).first()
    room = (S.POOL_SIZE + S.SPILL_SIZE) // 256
    assert got[0] == 2_000_000 and got[1] == got[2] == room and got[3] == 254 * 2**24 - 256


def test_addresses_beyond_the_space_have_their_own_stand_ins(spark, monkeypatch):
    monkeypatch.setattr(S, "POOL_SIZE", 2**10)
    monkeypatch.setattr(S, "SPILL_SIZE", 2**10)
    values = spark.range(3000).selectExpr("'' tenant", "concat('10.', id div 100, '.', id % 100, '.', id % 7) value", "'ip_address' category")
    minted, subnets = M.mint(values, KEYS, categories=["ip_address"])
    rows = M.fix_collisions(minted, KEYS).collect()
    assert len(rows) == 3000 == len({r.fake for r in rows}) and sum(r.fake.startswith("254.") for r in rows) == 2992
    again, kept = M.mint(values, KEYS, existing_subnets=materialize(subnets, "earlier"), categories=["ip_address"])
    assert kept.filter("fake_net is null").count() == 2992
    assert {(r.real, r.fake) for r in again.collect()} == {(r.real, r.fake) for r in minted.collect()}
    asked = spark.createDataFrame([("", "254.1.2.3")], "tenant string, value string")
    assert S.residual_v4(asked, subnets).count() == 0


@pytest.mark.parametrize("short,full", [("fd00::1", "fd00:0000:0000:0000:0000:0000:0000:0001"), ("2001:db8:0:1::", "2001:0db8:0000:0001:0000:0000:0000:0000"),
                                        ("::", "0000:0000:0000:0000:0000:0000:0000:0000"), ("1:2:3:4:5:6:7:8", "0001:0002:0003:0004:0005:0006:0007:0008")])
def test_ipv6_forms(spark, short, full):
    row = spark.createDataFrame([(short, full)], "s string, f string").select(ip.expand_ipv6(F.col("s")), ip.compress_ipv6(F.col("f"))).first()
    assert row[0] == full and row[1] == (short if short != "2001:db8:0:1::" else "2001:db8:0:1::")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 2**128 - 1), min_size=1, max_size=20))
def test_ipv6_equals_the_standard_library(spark, numbers):
    import ipaddress

    rows = [(ipaddress.IPv6Address(n).exploded,) for n in numbers]
    for full, short, again in spark.createDataFrame(rows, "f string").select("f", ip.compress_ipv6(F.col("f")), ip.expand_ipv6(ip.compress_ipv6(F.col("f")))).collect():
        assert again == full and ipaddress.ip_address(short).exploded == full


def test_chain_detects_changes_and_segments(spark):
    rows = [("s", i, 1000 + i, "obfuscation", {"email": i + 1}) for i in range(25)]
    df = spark.createDataFrame(rows, "session string, seq bigint, ts bigint, event_type string, categories map<string,bigint>")
    import hashlib
    import hmac

    for segment in (10**6, 10):
        chained = materialize(audit.chain(df, "key", segment), "c")
        assert audit.verify_chain(chained, "key").first().valid
        broken = chained.withColumn("ts", F.when(F.col("seq") == 12, F.lit(0).cast("bigint")).otherwise(F.col("ts")))
        assert audit.verify_chain(broken, "key").first().first_bad == 12
        assert audit.seal(chained, "key").count() == (1 if segment > 25 else 3)
    last = "0" * 64
    got = {r.seq: r.chain_hash for r in audit.chain(df, "key").collect()}
    for s, i, ts, kind, cats in rows:
        last = hmac.new(b"key", f'{last}:{ts}:{kind}:{{"email":{i + 1}}}'.encode(), hashlib.sha256).hexdigest()
        assert got[i] == last


def test_evict_ranks_across_partitions(spark):
    store = spark.range(500).select(F.lit("t").alias("tenant"), F.col("id").cast("string").alias("real"), F.col("id").cast("string").alias("fake"),
                                    F.lit("custom").alias("category"), F.col("id").alias("seed"), (F.col("id") % 50).alias("first_seen"))
    kept = M.evict(store, 30).collect()
    assert len(kept) == 30 and {r.first_seen for r in kept} == {47, 48, 49}


def test_store_files(spark, tmp_path):
    store = spark.createDataFrame([("a", "r", "f", "custom", 1, 2), ("", "r2", "f2", "custom", 1, 2)], "tenant string, real string, fake string, category string, seed bigint, first_seen bigint")
    readers.write_store(store, str(tmp_path / "store"))
    assert sorted(readers.read_store(spark, str(tmp_path / "store")).collect()) == sorted(store.collect())
    (tmp_path / "rules.json").write_text('{"email": {"confidence": 0.5}, "mine": {"pattern": "ZZ"}}')
    rules = {r.name: r for r in readers.read_rules(spark, str(tmp_path / "rules.json"))}
    assert rules["email"].confidence == 0.5 and "mine" in rules
    readers.write_audit(spark.createDataFrame([("x",)], "line string"), str(tmp_path / "audit"))
    readers.write_stats(store.groupBy().count(), str(tmp_path / "stats"), "2026-01-01")
    assert spark.read.text(str(tmp_path / "audit")).first()[0] == "x"
    assert spark.read.json(str(tmp_path / "stats")).first()["count"] == 2
    (tmp_path / "sse.txt").write_text('event: a\ndata: {"type": "content_block_stop", "index": 3}\n\n: ping\n\n')
    rows = readers.read_sse(spark, str(tmp_path / "sse.txt")).orderBy("seq").collect()
    assert rows[0].event["index"] == 3 and rows[1].event is None
    (tmp_path / "h.jsonl").write_text('{"session_id": "a", "ts": 104, "text": "hi"}\n{bad\n{"session_id": "a", "ts": 1, "text": "exit"}\n')
    s = audit.history_summary(readers.read_history(spark, str(tmp_path / "h.jsonl"))).first()
    assert (s.prompts, s.sessions, s.last_prompt_ms) == (1, 1, 104000)


def test_batch_restores_what_it_minted(spark):
    ops = spark.createDataFrame([(0, "", "obfuscate", "ssn 123-45-6789"), (1, "", "x", "")], "idx bigint, tenant string, direction string, text string")
    config = Config(KEYS, R.named("ssn"), context=False, code=False)
    fake = process_batch(ops, config).filter("idx = 0").first().text
    both = ops.unionByName(spark.createDataFrame([(2, "", "deobfuscate", fake)], ops.schema))
    out = {r.idx: r for r in process_batch(both, config).collect()}
    assert out[2].text == "ssn 123-45-6789" and out[2].n == 1 and out[1].error == "Unknown direction: x"


def test_public_hosts_pass(docs_of, spark):
    hosts = spark.createDataFrame([("arxiv.org",)], "host string")
    docs = docs_of("see https://arxiv.org/abs/1 and https://wiki.corp.net/x")
    out = obfuscate(docs, Config(KEYS, R.named("url"), context=False, code=False, resolved_public=hosts)).docs.first().text_out
    assert "https://arxiv.org/abs/1" in out and "wiki.corp.net" not in out


def test_shared_folder_is_required_on_a_cluster():
    from veilframe import session

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()
        class sparkContext:
            master = "spark://x:7077"

    with pytest.raises(ValueError):
        session.shared_dir(Fake())


def test_payloads_are_edited_some_rows_at_a_time():
    from pyspark.util import PythonEvalType
    from veilframe.operators.payload import edit_strings

    assert edit_strings.evalType == PythonEvalType.SQL_BATCHED_UDF  # not thousands of payloads in one Arrow batch
