"""The NULL, UNKNOWN, cycle and skew branches of the operators on small literal tables."""
from pyspark.sql import functions as F

from fenceline.functions import net, text as X, version as VV
from fenceline.functions.compare import judge
from fenceline.functions.threeval import fold_and, fold_or
from fenceline.operators import change as CH, controls as C, detect as D, extended as E, logs as L, policy as G, retrieval as Q, workflow as R
from fenceline.types import TVAL, tval_py

RULES = ("device_id string, id string, name string, ord int, enabled boolean, action string, src array<string>, dst array<string>, svc array<string>, src_bad array<string>, dst_bad array<string>, svc_bad array<string>, "
         "source_zones array<string>, destination_zones array<string>, hit_count bigint, program string")
POL = "device_id string, default_action string, default_action_observed boolean, unordered boolean, untrusted_zones array<string>"
QRY = "query_id string, device_id string, source string, destination string, port int, protocol string, source_zone string, destination_zone string"
ANY = ["0.0.0.0/0"]


def rule(i, action="allow", src=ANY, dst=ANY, svc=("tcp/22",), sb=(), db=(), vb=(), sz=(), dz=(), hits=None, program=None, enabled=True, name=None, dev="d"):
    return (dev, f"r{i:05d}", name or f"rule {i}", i, enabled, action, list(src), list(dst), list(svc), list(sb), list(db), list(vb), list(sz), list(dz), hits, program)


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), RULES)


def pol(spark, action="deny", observed=True, unordered=False, zones=(), dev="d"):
    return spark.createDataFrame([(dev, action, observed, unordered, list(zones))], POL)


def test_operators_cover_every_state(spark):
    cases = [("equals", True, 1, "PASS"), ("equals", None, True, "FAIL"), ("not_equals", None, 1, "PASS"), ("in", "b", ["a", "b"], "PASS"), ("in", None, ["a"], "FAIL"), ("not_in", None, ["a"], "PASS"),
             ("gte", None, 1, "UNKNOWN"), ("gte", ["5", "1"], 3, "FAIL"), ("gte", ["5", "x"], 3, "UNKNOWN"), ("gte", [], 3, "UNKNOWN"), ("lte", " 2.5 ", 3, "PASS"), ("lte", "abc", "abd", "PASS"),
             ("contains_all", ["A"], ["a", "b"], "PARTIAL"), ("contains_all", None, [], "PASS"), ("contains_all", ["x"], ["a"], "FAIL"), ("contains_none", ["DES", "aes"], ["des"], "FAIL"), ("contains_none", None, ["des"], "PASS"),
             ("min_count", ["a"], 2, "PARTIAL"), ("min_count", None, 1, "FAIL"), ("min_count", "one", "1", "PASS"), ("min_count", "one", "x", "UNKNOWN"), ("max_count", None, 0, "PASS"), ("max_count", ["a"], 0, "FAIL"),
             ("matches", "Hello", "^hel", "PASS"), ("matches", None, "x", "FAIL"), ("is_set", "  ", None, "FAIL"), ("is_set", [], None, "FAIL"), ("is_set", False, None, "PASS"), ("nonsense", 1, 1, "ERROR")]
    from pyspark.sql import types as T
    s = T.StructType([T.StructField("op", T.StringType()), T.StructField("v", TVAL), T.StructField("x", TVAL), T.StructField("want", T.StringType())])
    df = judge(spark.createDataFrame([(o, tval_py(a), tval_py(b), w) for o, a, b, w in cases], s), "op", "v", "x", "got")
    assert [(r.op, r.got) for r in df.where("got != want").collect()] == []


def test_threeval_folds(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", None), ("c", False), ("c", None), ("d", None)], "k string, v boolean")
    got = {r.k: (r.a, r.o) for r in df.groupBy("k").agg(fold_and(F.col("v")).alias("a"), fold_or(F.col("v")).alias("o")).collect()}
    assert got == {"a": (True, True), "b": (None, True), "c": (False, None), "d": (None, None)}
    e = df.where("false").agg(fold_and(F.col("v")).alias("a"), fold_or(F.col("v")).alias("o")).first()
    assert (e.a, e.o) == (True, False)


def test_address_containment(spark):
    rows = [("10.0.0.0/8", "10.1.2.3", True), ("any", "1.2.3.4", True), ("10.0.0.1", "any", False), ("10.0.0.0-10.0.0.9", "10.0.0.5", True), ("10.0.0.0-10.0.0.9", "10.0.0.10", False), ("2001:db8::/32", "2001:db8:1::5", True),
            ("2001:db8::/33", "2001:db8:8000::5", False), ("sg-1", "sg-1", True), ("sg-1", "sg-2", False), ("10.0.0.0/255.255.0.0", "10.0.3.0/24", True), ("10.0.0.0/30", "10.0.0.0/29", False), ("999.1.1.1", "1.1.1.1", False)]
    df = spark.createDataFrame(rows, "v string, c string, e boolean").withColumn("g", net.addr_in("v", "c"))
    assert df.where("g != e or g is null").count() == 0


def test_resolution_cycles_missing_and_unknown(spark):
    o = spark.createDataFrame([("d", n, "address_group", v, {"members_unknown": "true"} if u else {}) for n, v, u in
                               [("a", [], 0), ("b", [], 0), ("leaf", ["10.0.0.1"], 0), ("empty", [], 0), ("cloud", [], 1), ("g1", [], 0), ("g2", [], 0), ("g3", [], 0), ("dia", [], 0), ("x", [], 0), ("y", [], 0)]],
                              "device_id string, name string, kind string, values array<string>, attrs map<string,string>")
    m = spark.createDataFrame([("d", p, c, i) for p, c, i in [("a", "b", 0), ("b", "a", 0), ("g1", "leaf", 0), ("g1", "any", 1), ("g2", "gone", 0), ("g2", "a", 1), ("g3", "a", 0), ("g3", "gone", 1), ("dia", "g1", 0), ("dia", "leaf", 1),
                                                              ("x", "cloud", 0), ("x", "leaf", 1), ("y", "leaf", 0), ("y", "y", 1)]], "device_id string, parent string, child string, ordinal bigint")
    got = {r.name: r for r in G.resolve_objects(o, m).collect()}
    assert {k: got[k].state for k in ("a", "b", "g1", "g2", "g3", "dia", "x", "y", "empty", "cloud", "gone")} == {
        "a": "CYCLIC", "b": "CYCLIC", "g1": "RESOLVED", "g2": "UNRESOLVED", "g3": "CYCLIC", "dia": "RESOLVED", "x": "UNSUPPORTED", "y": "CYCLIC", "empty": "UNRESOLVED", "cloud": "UNSUPPORTED", "gone": "UNRESOLVED"}
    assert sorted(got["dia"].values) == ["0.0.0.0/0", "10.0.0.1"] and got["g2"].path == ["g2", "gone"]
    assert {r.name: r.state for r in G.resolve_objects(o, m, propagate_unsupported=False).collect()}["x"] == "RESOLVED"


def test_hygiene_first_coverer_counters_and_family(spark):
    r = rules(spark, rule(1, hits=9), rule(2, hits=0), rule(3, action="deny", hits=None), rule(4, hits=5), rule(5, enabled=False), rule(6, name="v6 rule"), rule(7, src=["10.0.0.1"], sb=["gone"]), rule(8, dst=["10.0.0.0/8"], svc=["tcp/22", "tcp/23"]))
    got = {(x.kind, x.rule_id): x.related for x in G.hygiene(r, pol(spark)).collect()}
    assert got[("redundant_rule", "r00002")] == "rule 1" and got[("shadowed_rule", "r00003")] == "rule 1" and got[("disputed_shadow", "r00004")] == "rule 1"
    assert ("unused_rule", "r00002") in got and ("disabled_rule", "r00005") in got and ("unevaluable", "r00007") in got
    assert not any(i in ("r00006", "r00008") and k.startswith(("red", "shad", "disp")) for k, i in got)
    assert G.covered(r, pol(spark, unordered=True)).count() == 0


def test_hygiene_equals_brute_force_on_a_hot_device(spark):
    import random
    rnd = random.Random(7)
    nets = [f"10.0.{i}.0/24" for i in range(4)]
    rows = [rule(i, action=rnd.choice(["allow", "deny"]), src=rnd.choice([ANY, rnd.sample(nets, 2), rnd.sample(nets, 1)]), dst=rnd.choice([ANY, rnd.sample(nets, 1)]), svc=rnd.choice([["any"], ["tcp/22"], ["tcp/22", "tcp/80"]]),
                 sz=rnd.choice([[], ["A"], ["a", "B"]])) for i in range(300)]
    def cover(a, b):
        wide = lambda s: not s or any(v in ("0.0.0.0/0", "any") for v in s)
        sets = all(wide(a[k]) or (not wide(b[k]) and set(b[k]) <= set(a[k])) for k in (6, 7, 8))
        za, zb = {z.lower() for z in a[12]}, {z.lower() for z in b[12]}
        return sets and (not za or (zb and zb <= za))
    want = {}
    for i, b in enumerate(rows):
        first = next((a[1] for a in rows[:i] if cover(a, b)), None)
        if first:
            want[b[1]] = first
    got = {x.id: x.related_id for x in G.covered(rules(spark, *rows), pol(spark)).collect()}
    assert got == want and len(want) > 100


def test_reach_skips_what_it_cannot_read(spark):
    r = rules(spark, rule(1, sb=["gone"], src=["10.9.0.0/16"]), rule(2, program="app"), rule(3, action="deny", src=["10.0.0.0-10.0.0.9"], svc=["tcp/1-100"]), rule(4, vb=["gone"], svc=[]), rule(5, svc=["any"], sz=["WAN"]))
    q = spark.createDataFrame([("in", "d", "10.0.0.5", "8.8.8.8", 22, "tcp", "", ""), ("saved", "d", "10.9.1.1", "8.8.8.8", 22, "tcp", "", ""), ("out", "d", "10.1.0.5", "8.8.8.8", 22, "tcp", "wan", ""), ("lan", "d", "10.1.0.5", "8.8.8.8", 22, "tcp", "lan", ""),
                              ("noport", "d", "10.1.0.5", "8.8.8.8", None, "tcp", "", ""), ("any", "d", "any", "any", 99, "tcp", "lan", "")], QRY)
    got = {x.query_id: (x.permitted, x.decided_by, x.evaluated, x.unevaluable, x.zone_assumed) for x in G.reach(q, r, pol(spark, observed=False)).collect()}
    assert got["in"] == (False, "rule 3", 3, 2, False)
    assert got["saved"] == (True, "rule 1", 1, 0, False)
    assert got["out"] == (True, "rule 5", 5, 3, False)
    assert got["lan"] == (None, "", 4, 3, False)
    assert got["noport"] == (True, "rule 2", 2, 1, False)
    assert got["any"][0] is None
    assert G.reach(q.where("query_id = 'lan'"), r, pol(spark)).first().decided_by == "default policy"


def test_exposure_clean_needs_every_rule_read(spark):
    p = pol(spark, zones=["WAN"])
    dirty = rules(spark, rule(1, sz=["LAN"]), rule(2, sb=["gone"], sz=["wan"]))
    s = G.fact_status(dirty, G.exposure(dirty, p, "admin"), p).first()
    assert (s.state, s.hits, s.skipped) == ("UNPARSED", 0, 1)
    clean = rules(spark, rule(1, sz=["LAN"]))
    assert G.fact_status(clean, G.exposure(clean, p, "admin"), p).first().state == "DEFAULT_ASSUMED"
    wide = rules(spark, rule(1, sz=["wan"], svc=["0.0.0.0/0"]))
    assert G.exposure(wide, p, "admin").count() == 1 and G.exposure(wide, p, "admin", any_service_is_all=False).count() == 0


def test_versions(spark):
    rows = [("7.3.0-7012-R8150", "7.3.0-7012", 0), ("7.3.0-7011", "7.3-7012", -1), ("7.3.0", "7.3.0-7012", None), ("7.3.0", "7.3", 0), ("6.5.4.4-44n", "6.5.4.4", 0), ("7.10.0", "7.9", 1), ("x", "1.0", None)]
    df = spark.createDataFrame(rows, "d string, b string, e int").withColumn("g", VV.compare_versions(VV.version_key(F.col("d")), VV.version_key(F.col("b"))))
    assert df.where("not (g <=> e)").count() == 0
    c = spark.createDataFrame([("17.9", "17.9.3", True), ("10.10", "FL.10.10.1010", True), ("21.4", "21.3R1", False), ("x", "1", None)], "v string, d string, e boolean")
    assert c.withColumn("g", VV.version_covers(F.col("v"), F.col("d"))).where("not (g <=> e)").count() == 0


def test_cve_three_valued(spark):
    t = "struct<criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>"
    sch = f"cve_id string, status string, configurations array<struct<operator:string,negate:boolean,nodes:array<struct<operator:string,negate:boolean,cpeMatch:array<{t}>>>>>"
    sw = lambda end: (f"cpe:2.3:o:acme:os:*:*", None, None, None, end)
    hw = lambda m: (f"cpe:2.3:h:acme:{m}:-:*", None, None, None, None)
    both = lambda end, m: [("AND", False, [("OR", False, [sw(end)]), ("OR", False, [hw(m)])])]
    c = spark.createDataFrame([("C1", "ok", both("8.0", "m1")), ("C2", "ok", both("7.0", "m1")), ("C3", "ok", both("7.3-9", "m1")), ("C4", "rejected", both("8.0", "m1")), ("C5", "ok", [("OR", False, [("OR", True, [hw("m9")])])])], sch)
    d = spark.createDataFrame([("d1", "7.3", "M1", "o", "acme", "os"), ("d2", "7.3", None, "o", "acme", "os")], "device_id string, version string, model string, part string, vendor string, product string")
    got = {(r.device_id, r.cve_id): r.affected for r in E.match_cve(d, c).collect()}
    assert got == {("d1", "C1"): True, ("d1", "C3"): None, ("d1", "C5"): True, ("d2", "C1"): None, ("d2", "C3"): None, ("d2", "C5"): None}


def test_logs_forms(spark):
    lines = ["Jan  5 10:00:00 fw id=1 rule=\"7 a\" action=weird drop src=1.1.1.1", "%ASA-6-302013: Built inbound TCP connection", "2024-01-02 03:04:05 permit policyid=9 dstport=22", "nothing here", " "]
    got = L.parse_logs(spark.createDataFrame([(x,) for x in lines], "value string"), 2023).collect()
    e = [(r.parsed, r.rule_id, r.action, str(r.ts)) for r in got]
    assert e[0] == (True, "7 a", "weird", "2023-01-05 10:00:00") and e[1][:3] == (True, "", "allow") and e[2] == (True, "9", "allow", "2024-01-02 03:04:05") and e[3][0] is False and len(e) == 4


def test_detectors_respect_negation_and_context(spark):
    lines = ["no ip http server", "ip http secure-server", "description DES-MOINES-UPLINK cipher", "telnet timeout 5", "enable password Marcraft1", "enable password $8$xK2p encrypted", "snmp-server community public RO", "! telnet", "crypto ipsec esp-des esp-md5-hmac"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "device_id string, line int, text string")
    assert {(r.line, r.detector) for r in D.detect(df).collect()} == {(4, "cleartext_credential"), (6, "default_snmp_community"), (6, "cleartext_credential"), (8, "weak_crypto")}
    many = spark.createDataFrame([("f", i, "transport input telnet") for i in range(40)], "device_id string, line int, text string")
    assert D.detect(many, cap=25).count() == 25 and D.detect(many).count() == 40


def test_direction_and_attribution(spark):
    df = spark.createDataFrame([("UNKNOWN", "PASS", "coverage_change"), ("FAIL", "PARTIAL", "improved"), ("PASS", "NOT_APPLICABLE", "regressed"), ("PASS", "FAIL", "regressed")], "b string, a string, e string")
    assert df.where(CH.direction(F.col("b"), F.col("a")) != F.col("e")).count() == 0


def test_certify_needs_an_owner(spark):
    import pytest
    reg = spark.createDataFrame([("d", "r1", "ann", "2020-01-01", 365)], "device_id string, rule_id string, owner string, certified_at string, period_days int")
    assert R.certify(reg, reg.withColumn("owner", F.lit("bob "))).first().owner == "bob"
    with pytest.raises(Exception):
        R.certify(reg, reg.withColumn("owner", F.lit(" "))).collect()


def test_chain_detects_tampering(spark):
    sch = "log_id int, seq int, field string, line string, platform string, vendor string, value string, approved_by string, approved_at string"
    import itertools
    base = spark.createDataFrame([(1, i, "f", f"l{i}", "p", "v", "x", "me", "t") for i in range(3)], sch)
    rows, prev = [], ""
    for r in base.orderBy("seq").collect():
        one = spark.createDataFrame([r], sch).withColumn("prev_hash", F.lit(prev)).withColumn("record_hash", Q.record_hash()).first()
        rows.append(one)
        prev = one.record_hash
    df = spark.createDataFrame(rows)
    assert Q.verify_chain(df).first().intact
    assert Q.verify_chain(df.withColumn("value", F.when(F.col("seq") == 1, "y").otherwise(F.col("value")))).first().first_broken == 1


def test_export_gate(spark):
    import pytest
    d = spark.createDataFrame([("a", "text", "t", "public_domain"), ("b", "secret", "t", "identifier_only")], "doc_id string, text string, title string, license string")
    assert Q.assert_exportable(Q.exportable(d)).count() == 2
    with pytest.raises(Exception):
        Q.assert_exportable(d).collect()


def test_twins_are_reported_by_class(spark):
    r = rules(spark, rule(1, enabled=False), rule(2), rule(3), rule(4, action="deny")).select("*", F.col("src").alias("source"), F.col("dst").alias("destination"), F.col("svc").alias("services"))
    got = C.twins(r, r.where("not enabled").select("device_id", F.col("id").alias("rule"))).collect()
    assert {(x.rule, x.role) for x in got} == {("r00001", "disabled"), ("r00002", "still_open"), ("r00003", "still_open")}


def test_split_cli_line(spark):
    rows = [("ssh key-exchange group dh-group1-sha1", "ssh key-exchange group", "dh-group1-sha1"), ("exec-timeout 10 0", "exec-timeout", "10 0"), ("a=b=c", "a", "b=c"), ("logging on", "logging on", ""), ("10 20", "10", "20")]
    df = spark.createDataFrame(rows, "raw string, n string, v string").withColumn("g", X.split_cli_line(F.col("raw")))
    assert [(r.raw, r.g) for r in df.where("g.name != n or g.value != v").collect()] == []


def test_small_groups_are_covered_without_the_index_and_alike(spark, monkeypatch):
    import random
    rnd = random.Random(3)
    rows = [rule(i, action=rnd.choice(["allow", "deny"]), src=rnd.choice([ANY, ["10.0.0.0/24"], ["10.0.0.0/24", "10.0.1.0/24"]]), svc=rnd.choice([["any"], ["tcp/22"]]), sz=rnd.choice([[], ["A"]])) for i in range(25)]
    r, found = rules(spark, *rows), lambda: sorted((x.id, x.related_id, x.kind) for x in G.covered(rules(spark, *rows), pol(spark)).collect())
    monkeypatch.setattr(G, "FEW", 0)
    want = found()
    monkeypatch.setattr(G, "FEW", 32)
    monkeypatch.setattr(G, "_covered_by_index", None)
    assert found() == want and len(want) > 5 and r.count() == 25
