"""Nothing is capped: nesting, indentation, detections and statements on a line."""
import json

from pyspark.sql import functions as F

from fenceline.functions import text as T
from fenceline.operators import detect as D, logs as L, policy as G
from fenceline.sources import files as S


def lines(spark, texts, device="d"):
    return spark.createDataFrame([(device, i + 1, t) for i, t in enumerate(texts)], "device_id string, line int, text string")


def test_wide_indentation_has_the_right_parents(spark):
    d = lines(spark, ["a"] + [" " * n + f"w{n}" for n in (4, 12, 16, 40)] + [" " * 14 + "back"])
    got = {r.text.strip(): r.parent_line for r in S.read_indented_config(d).collect()}
    assert got == {"a": None, "w4": 1, "w12": 2, "w16": 3, "w40": 4, "back": 3}


def test_deep_blocks(spark):
    n = 25
    d = lines(spark, [f"config c{i}" for i in range(n)] + ["set x 1"] + ["end"] * n + ["config top", "set y 2", "end"])
    got = {r.path: r.value for r in S.read_block_config(d).collect()}
    assert got == {"/".join([f"c{i}" for i in range(n)] + ["x"]): "1", "top/y": "2"}


def test_many_statements_on_a_line_keep_their_order(spark):
    d = lines(spark, ["a { " + " ".join(f"k{i} v{i};" for i in range(1500)) + " }", "b c;"])
    got = sorted((r.ordinal, r.path) for r in S.read_braces_config(d).collect())
    assert [p for _, p in got] == [f"a/k{i}" for i in range(1500)] + ["b"] and len({o for o, _ in got}) == 1501


def test_deep_json_beside_a_good_file(spark):
    deep = "1"
    for i in range(20):
        deep = json.dumps({f"k{i}": json.loads(deep)})
    f = spark.createDataFrame([("deep", deep), ("good", '{"a": [1, {"b": "x"}]}'), ("bad", "{")], "device_id string, content string")
    got = {(r.device_id, r.path): r.value for r in S.read_json_leaves(f).collect()}
    assert got[("deep", ".".join(f"k{i}" for i in range(19, -1, -1)))] == "1" and got[("good", "a.[1].b")] == "x" and ("bad", "") in got


def test_all_detections_are_returned(spark):
    d = lines(spark, ["transport input telnet"] * 60)
    assert D.detect(d).count() == 60 and D.detect(d, cap=D.CAP).count() == D.CAP
    total = [r.n for r in D.summarise(D.detect(d)).collect() if r.detector is None and r.severity is None]
    assert total == [60]


def test_groups_nested_far_down(spark):
    n = 30
    o = spark.createDataFrame([("d", f"g{i}", "group", [], {}) for i in range(n)] + [("d", "leaf", "address", ["10.0.0.1"], {})], "device_id string, name string, kind string, values array<string>, attrs map<string,string>")
    m = spark.createDataFrame([("d", f"g{i}", f"g{i + 1}" if i + 1 < n else "leaf", 0) for i in range(n)], "device_id string, parent string, child string, ordinal bigint")
    got = {r.name: (r.state, r["values"]) for r in G.resolve_objects(o, m).collect()}
    assert len(got) == n + 1 and all(v == ("RESOLVED", ["10.0.0.1"]) for v in got.values())


def test_log_pairs_last_value_and_spellings(spark):
    rows = ['rule=1 rule=2 action=deny src="10.0.0.1" dst=10.0.0.2 dport=22', 'policyid=7 something Denied srcip=1.1.1.1 proto="" protocol=udp', "policy= ruleid=\"x y\" permit drop", "nothing here", "%ASA-4-106023: Deny tcp", "x" * 500 + " rule=9"]
    d = spark.createDataFrame([(r,) for r in rows], "value string")
    got = {r.raw: r for r in L.parse_logs(d, 2024).where("parsed").collect()}
    assert (got[rows[0]].rule_id, got[rows[0]].action, got[rows[0]].src, got[rows[0]].port) == ("2", "deny", "10.0.0.1", "22")
    assert (got[rows[1]].rule_id, got[rows[1]].action, got[rows[1]].protocol) == ("7", "deny", "udp")
    assert (got[rows[2]].rule_id, got[rows[2]].action) == ("x y", "allow") and rows[3] not in got and got[rows[4]].action == "deny" and rows[5] in got


def test_synonyms_reach_their_word(spark):
    assert T.CANON["sshv2"] == "ssh" and T.CANON["login-message"] == "banner" and all(isinstance(v, list) for v in T.SYNONYMS.values())


def test_line_state_and_accounts_send_no_side_to_every_task(spark):
    """The estimate of lines knows only the table that the files were composed from."""
    from fenceline.operators import mapping as M
    from fenceline.sources import files as S
    f = spark.range(20).select(F.col("id").cast("string").alias("device_id"), F.lit("a\n b\n c\nd").alias("content"))
    l = S.read_indented_config(S.explode_lines(f))
    used = l.where("line = 2").select("device_id", "line")
    rows = spark.range(8).select(F.lit("d").alias("device_id"), F.col("id").alias("line"), F.lit(1).alias("delta"))
    for d in (l, M.account(l, used), M.unrecognised(l, used), S.depth_after(rows, ["device_id"], ["line"], "delta"), S.running_sum(rows, ["device_id"], ["line"], "before", F.lit(1))):
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    assert M.account(l, used).where("balances and mapped = 1 and parsed = 3").count() == 20


def test_config_files_are_read_once(spark):
    from fenceline.plans import load_all
    plan = load_all()[0]["read_config_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and "Join" not in plan


def test_xml_leaves_send_no_side_to_every_task(spark):
    d = S.read_xml_leaves(spark.createDataFrame([("d", "<a><b x='1'>t</b><c/></a>")], "device_id string, content string"))
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    assert [(r.path, r.value) for r in d.orderBy("ordinal").collect()] == [("b/@x", "1"), ("b", "t"), ("c", "<present>")]


def test_files_are_spread_before_they_grow(spark, tmp_path):
    from fenceline.plans import q_text
    spark.range(1, 4001).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    files = q_text.config_files(spark, str(tmp_path))
    used = files.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1 and files.count() == 4000
