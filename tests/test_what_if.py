"""Simulations on one small policy: nothing asked changes nothing, a disabled rule takes its facts along, its twin keeps the door open."""
import pytest

from fenceline.operators import controls as C, policy as G
from fenceline.session import cut_lineage

RULE = "device_id string, id string, name string, ord int, enabled boolean, action string, source array<string>, destination array<string>, services array<string>, src array<string>, dst array<string>, svc array<string>, src_bad array<string>, dst_bad array<string>, svc_bad array<string>, source_zones array<string>, destination_zones array<string>, logging boolean, hit_count bigint, program string, evidence array<struct<file:string,line:int,raw:string,record_id:string>>"
ANY = ["0.0.0.0/0"]


def rule(device, i, name, svc, enabled=True, action="allow", bad=()):
    return (device, i, name, int(i[1:]), enabled, action, ANY, ["10.0.0.5"], [svc], ANY, ["10.0.0.5"], [svc], list(bad), [], [], ["wan"], ["lan"], i != "r1", None, None, [("f", int(i[1:]), f"rule {i}", i)])


@pytest.fixture(scope="module")
def setting(spark):
    rules = spark.createDataFrame([rule("a", "r1", "ssh in", "tcp/22"), rule("a", "r2", "ssh in v6", "tcp/22"), rule("a", "r3", "old", "tcp/23", enabled=False), rule("b", "r1", "rdp", "tcp/3389"), rule("b", "r2", "RDP", "tcp/80", action="deny"), rule("c", "r1", "odd", "tcp/22", bad=["x"])], RULE)
    policies = spark.createDataFrame([(d, "deny", True, False, ["wan"]) for d in "abcd"], "device_id string, default_action string, default_action_observed boolean, unordered boolean, untrusted_zones array<string>")
    devices = policies.selectExpr("device_id", "'p' AS platform")
    controls = C.controls_df(spark, [{"id": "E", "field": "exposure.admin_ports_open_to_internet", "operator": "max_count", "expected": 0, "severity": "high"}, {"id": "L", "field": "firewall.rules.log", "operator": "equals", "expected": True, "severity": "low"},
                                     {"id": "T", "field": "management.timeout", "operator": "lte", "expected": 600, "severity": "low"}])
    obs = cut_lineage(G.policy_observations(rules, policies))
    return rules, policies, devices, controls, obs, cut_lineage(C.evaluate(devices, controls, obs))


def run(spark, setting, disabled, fixes=()):
    rules, policies, devices, controls, obs, found = setting
    after, changes, rejected = C.what_if(devices, controls, obs, found, spark.createDataFrame(list(fixes), "device_id string, control_id string"), rules=rules, disabled=spark.createDataFrame(list(disabled), "device_id string, rule string"), policies=policies)
    state = lambda f: {(r.device_id, r.control_id): r.state for r in f.collect()}
    return state(found), state(after), {(r.device_id, r.control_id): (r.before, r.after) for r in changes.collect()}, {(r.device_id, r.control_id, r.rule): (r.why, r.suggest) for r in rejected.collect()}


def test_an_empty_simulation_is_the_identity(spark, setting):
    before, after, changes, rejected = run(spark, setting, [])
    assert before == after and not changes and not rejected
    assert before[("a", "E")] == "FAIL" and before[("a", "L")] == "FAIL" and before[("c", "E")] == "UNKNOWN"


def test_disabling_derives_the_facts_of_that_device_anew(spark, setting):
    before, after, changes, rejected = run(spark, setting, [("b", "rdp"), ("c", "R1"), ("a", "SSH IN")])
    assert changes == {("b", "E"): ("FAIL", "PASS"), ("c", "E"): ("UNKNOWN", "PASS"), ("a", "L"): ("FAIL", "PASS"), **{k: v for k, v in changes.items() if k in {("b", "L"), ("c", "L")}}}
    assert after[("a", "E")] == "FAIL"  # its twin is open still
    assert {k: v for k, v in after.items() if k[0] == "d"} == {k: v for k, v in before.items() if k[0] == "d"} and not rejected


def test_what_cannot_be_simulated_is_said(spark, setting):
    before, after, changes, rejected = run(spark, setting, [("a", "old"), ("a", "nothing"), ("d", "r1")], [("a", "E"), ("d", "E"), ("a", "none"), ("a", "T")])
    assert before == after and not changes
    why = {k: v[0] for k, v in rejected.items()}
    assert why == {("a", None, "old"): "already disabled", ("a", None, "nothing"): "no rule with this name or id", ("d", None, "r1"): "no policy object graph", ("a", "E", None): "computed from policy", ("d", "E", None): "not a failure",
                   ("a", "none", None): "no such control", ("a", "T", None): "not a failure"}
