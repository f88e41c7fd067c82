"""Texts are told apart by row, whatever their ids; payload texts are never lost; odd host names do no harm."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions.keyed import Keys
from veilframe.operators.context import propagate_hostnames
from veilframe.operators.detect import ENTITY_COLUMNS
from veilframe.operators.payload import explode_messages
from veilframe.operators import rules as R
from veilframe.operators.restore import restore
from veilframe.plans.obfuscate import Config, obfuscate


def test_equal_ids_do_not_mix(spark):
    rows = [("a", 1, "first 123-45-6789 then 222-33-4444 end"), ("b", 1, "xx yyyyyyy 987-65-4321 z"), ("a", 2, "call 123-45-6789 now"), ("a", 2, "call 123-45-6789 now")]
    docs = spark.createDataFrame(rows, "tenant string, doc_id bigint, text string")
    result = obfuscate(docs, Config(Keys("secret", "salt"), context=False, code=False))
    out = result.docs.collect()
    assert sorted((r.tenant, r.doc_id, r.text) for r in out) == sorted(rows)
    for r in out:
        for real in ("123-45-6789", "222-33-4444"):
            assert real not in r.text_out
        assert len(r.text_out) == len(r.text) and r.text_out.split()[0] == r.text.split()[0] and r.text_out.split()[-1] == r.text.split()[-1]
    back = restore(result.docs.select("tenant", "doc_id", F.col("text_out").alias("text")), result.mapping).collect()
    assert sorted((r.tenant, r.doc_id, r.text_out) for r in back) == sorted(rows)


def test_texts_that_begin_like_json(spark):
    texts = ["[] my ssn 123-45-6789", "[1, 2] x", "[", '["a"]']
    rows = [(i, '{"messages":[{"role":"user","content":%s}],"system":%s}' % (q, q)) for i, t in enumerate(texts) for q in ['"' + t.replace('"', '\\"') + '"']]
    got = {(r.msg_id, r.path, r.text) for r in explode_messages(spark.createDataFrame(rows, "msg_id int, payload string")).collect()}
    assert got == {(i, p, t) for i, t in enumerate(texts) for p in ("system", "messages[0].content")}


def test_host_name_with_quote_end(spark):
    docs = spark.createDataFrame([("", 1, "hostname a\\E(b\nsee a\\E(b")], "tenant string, doc_id bigint, text string")
    none = spark.createDataFrame([], "tenant string, doc_id bigint, value string, start int, end int, category string, confidence double, detector string").select(*ENTITY_COLUMNS)
    assert propagate_hostnames(docs, none).count() >= 0


def test_long_paths_end_no_job(spark):
    rule = next(r for r in R.BUILTIN if r.name == "file_path_unix")
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("/\\aabb.-_ C:é/") for _ in range(rnd.randint(8, 60))) for _ in range(3000)] + ["/a" * 60_000 + " x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(F.regexp_extract_all("text", F.lit(R.java_pattern(rule)), F.lit(0))).collect()]
    assert got == [[m.group() for m in re.finditer(rule.pattern, t, re.ASCII)] for t in texts]
    assert sum(map(bool, got)) > 50


@pytest.mark.parametrize("name,letters,long", [
    ("email", ["a", "B", "7", ".", "-", "@", "_", "%", " ", "\u00e9", "a@b", ".com", ".x1"], "me@" + "a." * 60_000 + "org x"),
    ("file_path_windows", ["C:\\", "a", "B", "\\", ".", "-", "_", " ", "\u00e9", "/", ":"], "C:\\" + "a\\" * 60_000 + "b x"),
    ("ldap_bind_dn", ["CN=", ",OU=", ",DC=", ",O=", ",C=", ",", "a", "=", " ", "\u00e9"], "CN=x" + ",OU=y" * 60_000 + ",z"),
    ("historian_tag", ["\\\\", "\\", "a", "B", ".", "-", "_", " ", "\u00e9"], "\\\\srv" + "\\t" * 60_000 + " x")])
def test_long_names_end_no_job(spark, name, letters, long):
    rule = next(r for r in R.BUILTIN if r.name == name)
    rnd = random.Random(6)
    texts = ["".join(rnd.choices(letters, k=rnd.randint(4, 40))) for _ in range(20_000)] + [long]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(F.regexp_extract_all("text", F.lit(R.java_pattern(rule)), F.lit(0))).collect()]
    assert got == [[m.group() for m in re.finditer(rule.pattern, t, re.ASCII)] for t in texts]
    assert sum(map(bool, got)) > 50 and len(got[-1][0]) > 120_000
