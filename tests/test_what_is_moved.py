"""What is shuffled and written stays small beside the rows it stands for."""
import os

from pyspark.sql import functions as F

from fenceline.operators import controls as C, extended as E, jsonpath as J, policy as G, retrieval as Q
from fenceline.session import checkpoint_dir, cut_lineage


def shuffle_written(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    ex = sc.statusStore().executorList(False)
    return sum(ex.apply(i).totalShuffleWrite() for i in range(ex.size()))


def test_json_documents_are_not_shuffled(spark):
    doc = F.concat(F.lit('{"a": ['), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit('{"k": "'), F.sha2((i + F.col("id") * 41).cast("string"), 256), F.lit('"}'))), ","), F.lit("]}"))
    d = cut_lineage(spark.range(300).select(F.col("id").cast("string").alias("device_id"), F.lit("g").alias("group"), doc.alias("content")))
    e = spark.createDataFrame([("g", "$.a[*].k"), ("g", "$.a[7].k"), ("g", "$.a")], "group string, expr string")
    before = shuffle_written(spark)
    got = {r["expr"]: r["count"] for r in J.path_values(d, e).groupBy("expr").count().collect()}
    assert got == {"$.a[*].k": 300 * 41, "$.a[7].k": 300, "$.a": 300}
    assert shuffle_written(spark) - before < 100_000


def test_a_release_is_reported_once_for_its_devices(spark):
    m = "struct<criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>"
    sch = f"cve_id string, status string, configurations array<struct<operator:string,negate:boolean,nodes:array<struct<operator:string,negate:boolean,cpeMatch:array<{m}>>>>>, metric struct<base_score:double,base_severity:string>"
    c = spark.createDataFrame([(f"V-{i}", "Analyzed", [("OR", False, [("OR", False, [("cpe:2.3:o:acme:os:*:*", None, None, None, f"{i % 4}.5")])])], (i % 3 + 0.5, "HIGH")) for i in range(12)], sch)
    d = spark.createDataFrame([(f"d{i}", f"{i % 2 + 1}.0", "M1" if i % 3 else None, "o", "acme", "os") for i in range(30)], "device_id string, version string, model string, part string, vendor string, product string")
    kev = spark.createDataFrame([("V-3", "2025-01-01")], "cve_id string, due_date string")
    releases = E.match_releases(d, c)
    assert releases.count() * 5 <= E.match_cve(d, c).count()
    cols = ["device_id", "cve_id", "state", "severity", "known_exploited", "rank"]
    once = E.on_devices(d, E.cve_report(releases, c, kev, by="uid")).select(*cols)
    each = E.cve_report(E.match_cve(d, c), c, kev).select(*cols)
    assert sorted(once.collect()) == sorted(each.collect()) and each.count() > 0


def test_cut_tables_are_small_on_disk_and_whole(spark):
    def size():
        top = checkpoint_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(top) for f in fs)

    df = spark.range(30000).select("id", F.array(F.struct(F.lit("file of a device").alias("file"), (F.col("id") % 9).alias("line"))).alias("evidence"), F.lit("firewall.rules.action").alias("field"))
    before = size()
    assert cut_lineage(df).count() == 30000 and size() - before < 150_000
    odd = cut_lineage(df.select("id", F.lit(None).alias("nothing")))
    assert odd.count() == 30000 and odd.columns == ["id", "nothing"]


def test_only_settings_that_a_control_reads_are_kept(spark):
    ctl = C.controls_df(spark, [{"id": "A", "field": "x", "operator": "equals", "expected": 1, "severity": "low", "requires": [{"field": "y", "equals": True}]}])
    obs = spark.createDataFrame([("d", f) for f in "xyz"], "device_id string, field string")
    assert {r.field for r in C.read_observations(obs, ctl).collect()} == {"x", "y"}


def test_pairs_above_a_cosine_are_those_of_all_pairs(spark):
    words = ["lan", "wan", "vpn", "acl", "nat", "dns", "ntp", "tls"]
    text = lambda i: " ".join(words[(i * (k + 3) + k * k) % 8] for k in range(3 + i % 5))
    d = spark.createDataFrame([(i, text(i)) for i in range(60)] + [(60, ""), (61, None)], "doc_id long, text string")
    q = spark.createDataFrame([(i, text(i * 7 + 1)) for i in range(9)] + [(9, "absent")], "query_id long, text string")
    every = {(r.query_id, r.doc_id): r.cosine for r in Q.tfidf_scores(q, d).collect()}
    got = {(r.query_id, r.doc_id): r.cosine for r in Q.tfidf_scores(q, d, above=0.3123).collect()}
    assert 0 < len(got) < len(every) and set(got) == {k for k, c in every.items() if c > 0.3123}
    assert all(abs(got[k] - every[k]) < 1e-12 for k in got)


def test_records_of_one_kind_are_judged_once(spark):
    m = "struct<criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>"
    sch = f"cve_id string, status string, configurations array<struct<operator:string,negate:boolean,nodes:array<struct<operator:string,negate:boolean,cpeMatch:array<{m}>>>>>"
    one = spark.createDataFrame([(str(i), "Analyzed", [("OR", i == 3, [("OR", False, [("cpe:2.3:o:acme:os:*:*", *b)])])]) for i, b in enumerate(
        [(None, None, None, "10.0"), ("10.0", None, None, None), (None, None, "10.0", None), (None, None, None, "10.0")])], sch)
    c = cut_lineage(spark.range(6000).join(one, F.col("id") % 4 == F.col("cve_id").cast("int")).select(F.concat(F.lit("V-"), F.col("id").cast("string")).alias("cve_id"), "status", "configurations"))
    d = cut_lineage(spark.range(60).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("device_id"), F.concat((F.col("id") % 20).cast("string"), F.lit(".0")).alias("version"),
                                           F.lit(None).cast("string").alias("model"), F.lit("o").alias("part"), F.lit("acme").alias("vendor"), F.lit("os").alias("product")))
    v, k = F.regexp_extract("version", r"^\d+", 0).cast("int"), F.substring("cve_id", 3, 9).cast("int") % 4
    right = F.when(k == 0, v < 10).when(k == 1, v >= 10).when(k == 2, v <= 10).otherwise(v >= 10)
    got = E.match_cve(d, c).agg(F.count(F.lit(1)).alias("n"), F.count_if(right & F.col("affected")).alias("ok"), F.sum(F.xxhash64("cve_id", "device_id").cast("decimal(38,0)")).alias("h")).first()
    want = d.crossJoin(c.select("cve_id")).where(right).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cve_id", "device_id").cast("decimal(38,0)")).alias("h")).first()
    assert got.n == got.ok == want.n and got.h == want.h
    assert E._class_verdicts(d, c, E._record_classes(c)).count() <= 4 * 20  # four kinds of records, twenty releases


def test_literals_are_resolved_within_their_rule(spark):
    lit = lambda i: F.concat(F.lit(f"10.{i}."), (F.col("id") % 250).cast("string"), F.lit(".0/24"))
    rules = cut_lineage(spark.range(3000).select((F.col("id") % 500).cast("string").alias("device_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"),
                                                 F.array(lit(0), lit(1)).alias("source"), F.array(F.lit("any"), F.lit("WEB")).alias("destination"), F.array(F.lit("tcp/22"), F.lit("GONE")).alias("services")))
    objects = spark.createDataFrame([("7", "WEB", "address", ["10.9.9.0/24"], {})], "device_id string, name string, kind string, values array<string>, attrs map<string,string>")
    res = cut_lineage(G.resolve_objects(objects, spark.createDataFrame([], "device_id string, parent string, child string, ordinal bigint")))
    before = shuffle_written(spark)
    got = G.resolve_rules(rules, res).select("device_id", F.size("src").alias("s"), F.array_join("dst", ",").alias("d"), F.array_join("dst_bad", ",").alias("b"), F.array_join("svc_bad", ",").alias("v")).collect()
    assert shuffle_written(spark) - before < 20_000
    assert len(got) == 3000 and all((r.s, r.v) == (2, "GONE") and (r.d, r.b) == (("0.0.0.0/0,10.9.9.0/24", "") if r.device_id == "7" else ("0.0.0.0/0", "WEB")) for r in got)


def test_observations_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(C, "OBSERVATIONS_A_TASK", 50, raising=False)
    ctl = C.controls_df(spark, [{"id": "A", "field": "x", "operator": "equals", "expected": 1, "severity": "low"}])
    value = "cast(null as struct<kind:string,b:boolean,n:double,s:string,l:array<string>>)"
    obs = spark.range(1000).selectExpr("cast(id as string) as device_id", "'x' as field", "cast(null as string) as scope", "id as ordinal", "'NOT_OBSERVED' as state", f"{value} as value", "1.0D as confidence",
                                       "cast(null as array<struct<file:string,line:int,raw:string,record_id:string>>) as evidence")
    devices = spark.range(1000).selectExpr("cast(id as string) as device_id", "'P' as platform")
    f = C.evaluate(devices, ctl, obs)
    assert f.count() == 1000 and "REPARTITION_BY_NUM" in f._jdf.queryExecution().toString() and ", 20), REPARTITION_BY_NUM" in f._jdf.queryExecution().toString()


def test_na_justified_evaluates_once(spark):
    from fenceline.plans.q_controls import na_justified
    plan = na_justified(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "c_custkey" not in plan  # both sides read the findings that were written


def first_join(df) -> str:
    return next(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)


def test_a_large_table_between_steps_is_not_broadcast_for_its_small_files(spark):
    n = 60001
    left = spark.range(10 ** 8).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("x"))
    rows = lambda m: cut_lineage(spark.range(m).select(F.col("id").cast("string").alias("k"), F.lit("much the same " * 20).alias("text")))
    assert "BroadcastHashJoin" not in first_join(left.join(rows(n), "k"))
    assert "BroadcastHashJoin" in first_join(left.join(rows(100), "k"))


def test_policies_of_many_devices_are_not_broadcast_to_their_questions(spark):
    few, many = (spark.range(n).select(F.col("id").cast("string").alias("device_id"), F.lit("deny").alias("default_action"), F.lit(True).alias("default_action_observed"), F.lit(False).alias("unordered")) for n in (50, 60001))
    none = F.array().cast("array<string>")
    rules = few.select("device_id", F.lit("r1").alias("id"), F.lit("all").alias("name"), F.lit(1).alias("ord"), F.lit(True).alias("enabled"), F.lit("allow").alias("action"), F.array(F.lit("0.0.0.0/0")).alias("src"), F.array(F.lit("0.0.0.0/0")).alias("dst"),
                       F.array(F.lit("tcp/1-100")).alias("svc"), *[none.alias(c) for c in ("src_bad", "dst_bad", "svc_bad", "source_zones", "destination_zones")], F.lit(None).cast("string").alias("program"))
    a = G.reach(G.standard_queries(few), rules, many)
    assert "SortMergeJoin" in first_join(a)
    assert {(r.port, r.permitted) for r in a.collect()} == {(p, p <= 100) for p in G.STANDARD_PORTS}


def test_what_is_known_of_devices_is_not_broadcast_to_them(spark):
    ctl = C.controls_df(spark, [{"id": "A", "field": "x", "operator": "equals", "expected": True, "severity": "low"}])
    d = spark.range(500).select(F.col("id").cast("string").alias("device_id"), F.lit("p").alias("platform"))
    tv = F.struct(F.lit("bool").alias("kind"), (F.col("device_id") % 2 == 0).alias("b"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("array<string>").alias("l"))
    none = F.array().cast("array<struct<file:string,line:int,raw:string,record_id:string>>")
    obs = cut_lineage(d.select("device_id", F.lit("x").alias("field"), F.lit(None).cast("string").alias("scope"), F.lit(0).cast("long").alias("ordinal"), F.lit("OBSERVED").alias("state"), tv.alias("value"), F.lit(1.0).alias("confidence"), none.alias("evidence")))
    f = C.evaluate(d, ctl, obs)
    joins = [line for line in f._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "device_id" in line]
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert {r.state: r["count"] for r in f.groupBy("state").count().collect()} == {"PASS": 250, "FAIL": 250}


def test_exposure_facts_come_out_of_one_pass_over_the_rules(spark):
    none = F.array().cast("array<string>")
    rules = spark.createDataFrame([("a", "r1", "z1", "tcp/22", ""), ("a", "r2", "z2", "tcp/22", ""), ("b", "r1", "z1", "tcp/22", "GONE"), ("c", "r1", "z1", "any", "")], "device_id string, id string, z string, s string, g string").select(
        "device_id", "id", F.col("id").alias("name"), F.lit(True).alias("enabled"), F.lit("allow").alias("action"), F.array(F.lit("0.0.0.0/0")).alias("src"), F.array(F.lit("0.0.0.0/0")).alias("dst"), F.array("s").alias("svc"), F.array("s").alias("services"),
        none.alias("src_bad"), none.alias("dst_bad"), F.when(F.col("g") == "", none).otherwise(F.array("g")).alias("svc_bad"), F.array("z").alias("source_zones"))
    policies = spark.createDataFrame([(d, ["z1"]) for d in "abcd"], "device_id string, untrusted_zones array<string>")
    o = G.exposure_observations(rules, policies)
    assert o._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + o._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 3
    got = {(r.device_id, r.field.split(".")[1]): (r.state, r.value and r.value.l) for r in o.collect()}
    admin, every = {d: got[d, "admin_ports_open_to_internet"] for d in "abcd"}, {d: got[d, "any_any_rules"] for d in "abcd"}
    assert admin == {"a": ("OBSERVED", ["r1:22"]), "b": ("UNPARSED", None), "c": ("OBSERVED", ["r1:22/23/80/161/443/3389/5900"]), "d": ("DEFAULT_ASSUMED", [])}
    assert every == {"a": ("DEFAULT_ASSUMED", []), "b": ("UNPARSED", None), "c": ("OBSERVED", ["r1"]), "d": ("DEFAULT_ASSUMED", [])}
