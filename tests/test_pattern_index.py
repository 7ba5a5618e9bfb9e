"""The pattern index against plain matching, taught signatures with faults, and path expressions."""
import random
import re

import pytest
from pyspark.sql import functions as F

from fenceline.operators import identify as I, jsonpath as J, literals as L, mapping as M, retrieval as Q

PATTERNS = [r"^hostname (\S+)", r"^(no )?ip http server", r"(?i)^\s*SNMP-server\s+community\s+(\S+)", r"foo|bar\b", r"\d+ .*", r"^ab\s*cd ", r"des", r"(?:set|delete) \S+ x$", r"a{2,3}b c$", r"\bip\b",
            r"(snmp|ntp) (server|host) x", r"^$", r".", r"user(name)? \w+ priv 15", r"[Ff]oo-bar", r"x?y z ", r"(a|b)(c|d)(e|f) g ", r"one_two three ", r"\S+ des\b", r"^\[edit", r"(?x) al pha \s beta \s", r"é foo ", r"q(?=uit) ", r"(?!no )ip route"]


def test_no_match_is_lost_for_want_of_a_key():
    r = random.Random(8)
    bits = ["hostname", "ip", "http", "server", "no", "SNMP-server", "community", "foo", "bar", "foobar", "12", "ab", "cd", "abcd", "des", "des3", "set", "delete", "x", "aab", "aaab", "c", "snmp", "ntp", "host", "username", "user", "u1", "priv", "15", "15x",
            "Foo-bar", "y", "z", "ace", "bdf", "g", "one_two", "three", "[edit", "alpha", "beta", "é", "quit", "route", "_ip_", "-ip-"]
    compiled = [(p, re.compile(p), set(L.needed_keys(p))) for p in PATTERNS]
    for _ in range(4000):
        text = r.choice([" ", "", "  "]).join([r.choice(["", " "]), *[r.choice(bits) + r.choice([" ", "", "-", "_", "é"]) for _ in range(r.randint(0, 6))]])
        words = [w for w in re.split("[^a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
        have = {"", *words, *("g:" + w[i : i + 3] for w in words for i in range(len(w) - 2))}
        for p, search, keys in compiled:
            assert not search.search(text) or have & keys, (p, text)


def test_ten_thousand_patterns_meet_lines_by_key(spark):
    rows = [(i, f"f{i}", rf"^set knob{i} (\S+)" if i % 3 else rf"knob{i}(on|off) now") for i in range(10000)] + [(10001, "bad", "bad["), (10002, "any", r"\d{6}")]
    m = spark.createDataFrame(rows, "ordinal int, field string, regex string")
    lines = spark.createDataFrame([(f"set knob{k} v",) for k in range(0, 10000, 37)] + [(f"knob{k}on now",) for k in range(0, 10000, 37)] + [("123456",), ("",)], "text string")
    got = Q.corpus_from_packs(lines, m)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    compiled = [(f, re.compile(p)) for _, f, p in rows if p != "bad["]
    want = {(t, f) for (t,) in lines.collect() if t for f, p in compiled if p.search(t)}
    assert {(x.line, x.field) for x in got.collect()} == want
    assert [x.error for x in L.bad_patterns(m, "regex").collect()] == ["not a pattern: bad["]


def test_a_bad_taught_pattern_costs_only_its_platform(spark):
    files = spark.createDataFrame([("a", "alpha one\nbeta 7"), ("b", "gamma\nfox"), ("c", '{"TOP": {"k": 1}, "l": [1]}'), ("d", '[{"GroupX": null}]'), ("e", "alpha one")], "device_id string, content string")
    files = files.select("*", F.lit("UNKNOWN").alias("platform"), *[F.lit(None).cast("string").alias(c) for c in ("vendor", "reader", "os")], F.lit(0.0).alias("confidence"))
    taught = spark.createDataFrame([("p1", "v", "indented", "^alpha"), ("p1", "v", "indented", r"^beta \d"), ("p0", "v", "indented", "bad[pattern"), ("p0", "v", "indented", "^gamma"), ("p2", "v", "indented", "^fox$"), ("p3", "v", "json", "$.TOP.k"), ("p3", "v", "json", "$.l[0]"),
                                    ("p4", "v", "json", "$.TOP[?(@.k == 1)]"), ("p5", "v", "json", "$..k"), ("p6", "v", "json", "$[*].GroupX")], "platform string, vendor string, reader string, signature string")
    got = {r.device_id: r.platform for r in I.learned(files, taught).collect()}
    assert got == {"a": "p1", "b": "p2", "c": "p3", "d": "UNKNOWN", "e": "UNKNOWN"}
    assert {(r.platform, r.error.split(":")[0]) for r in I.taught_problems(taught).collect()} == {("p0", "not a pattern"), ("p5", "path not understood")}


def test_paths_reach_what_they_say(spark):
    doc = '{"a": {"b c": [ {"n": 2, "s": "x"}, {"n": 10, "s": "y"}, 5, null ]}, "e": [], "t": true, "x-y": {"z": {"n": 1}}}'
    docs = spark.createDataFrame([("d", "g", doc), ("bad", "g", "{"), ("other", "h", doc)], "device_id string, group string, content string")
    cases = {"$": None, "$.a.'b c'[*].n": ["2", "10"], "$.a['b c'][1].s": ["y"], "$.a.'b c'[?(@.n > 3)].s": ["y"], "$.a.'b c'[?(@.n)].s": ["x", "y"], "$.a.'b c'[?(@.s == 'x')].n": ["2"], "$.a.'b c'[?(@.s != \"x\")].n": ["10"], "$.a.'b c'[?(@.n <= 2)].n": ["2"],
             "$.*.z.n": ["1"], "$.e[*]": [], "$.e[0]": [], "$.t": ["true"], "$.a.n": [], "$.a[0]": [], "$[*].a": [], "$.x-y.z": ['{"n":1}'], "$..n": [], "a.b": [], "$.a.'b c'[2]": ["5"], "$.a.'b c'[3]": ["null"]}
    got = {}
    for r in J.path_values(docs, spark.createDataFrame([("g", e) for e in cases], "group string, expr string")).select("device_id", "expr", "ord", J.text_of(F.col("v")).alias("t")).collect():
        assert r.device_id == "d"
        got.setdefault(r.expr, []).append((r.ord, r.t))
    for e, want in cases.items():
        if want is not None:
            assert [t for _, t in sorted(got.get(e, []))] == want, e
    assert len(got["$"]) == 1


def test_scopes_are_containers_and_the_innermost_wins(spark):
    doc = '[{"id": "A", "kids": [{"id": "A1", "v": 1}, {"v": 2}], "v": 3}, {"v": 4}, {"id": "B", "v": "many"}]'
    m = M.mappings_df(spark, [{"platform": "p", "field": "f.all", "jsonpath": "$[*].kids[*].v", "scope": "$[*].id", "as_type": "list"}, {"platform": "p", "field": "f.one", "jsonpath": "$[*].v", "scope": "$[*].id", "as_type": "int"},
                              {"platform": "p", "field": "f.kid", "jsonpath": "$[*].kids[*].v", "scope": "$[*].kids[*].id", "as_type": "int"}, {"platform": "p", "field": "f.dup", "jsonpath": "$[0].id"}, {"platform": "p", "field": "f.dup", "jsonpath": "$[2].id"}])
    d = spark.createDataFrame([("x", "p", doc)], "device_id string, platform string, content string")
    got = {(r.field, r.scope): r for r in M.apply_mappings(d.select("device_id", "platform"), m, documents=d).collect()}
    assert got[("f.all", "A")].value.l == ["1", "2"] and got[("f.one", "A")].value.n == 3 and got[("f.one", "B")].state == "UNPARSED" and got[("f.one", "unscoped")].value.n == 4
    assert got[("f.kid", "A1")].value.n == 1 and got[("f.kid", "unscoped")].value.n == 2
    assert got[("f.dup", None)].value.s == "B" and len(got) == 7
    assert got[("f.kid", "A1")].evidence[0].raw == "[0].kids.[0].v = 1"


@pytest.mark.parametrize("line", [1, 2000])
def test_the_mapping_goes_before_the_place_in_the_file(spark, line):
    m = M.mappings_df(spark, [{"platform": "p", "field": "f", "parent": "^b", "regex": "late (.*)"}, {"platform": "p", "field": "f", "parent": "^a", "regex": "early (.*)"}])
    lines = spark.createDataFrame([("d", "p", line << 20, "late x", 1, "block two"), ("d", "p", 1, "early y", 1, "a block")], "device_id string, platform string, line long, text string, parent_line int, parent string")
    got = M.apply_mappings(lines.select("device_id", "platform").distinct(), m, lines=lines).orderBy("ordinal").collect()
    assert [(r.scope, r.value.s) for r in got if r.scope] == [("block two", "x"), ("a block", "y")]
