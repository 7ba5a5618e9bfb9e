"""Policy builders and readers on small exports written for the tests."""
import json

from pyspark.sql import functions as F

from fenceline.operators import policy as G
from fenceline.session import cut_lineage
from fenceline.sources import files as S, rules as B


def files(spark, content, dev="d"):
    return spark.createDataFrame([(dev, content)], "device_id string, content string")


def resolved(t):
    for k in list(t):
        t[k] = cut_lineage(t[k])
    return G.resolve_rules(t["rules"], G.resolve_objects(t["objects"], t["members"], G.rule_names(t["rules"])))


def ask(spark, t, *questions):
    """permitted for each question, in order."""
    base = {"device_id": "d", "source": "any", "destination": "any", "port": 22, "protocol": "tcp", "source_zone": "", "destination_zone": ""}
    rows = [{"query_id": str(i), **base, **q} for i, q in enumerate(questions)]
    df = spark.createDataFrame(rows, "query_id string, device_id string, source string, destination string, port int, protocol string, source_zone string, destination_zone string")
    return [r.permitted for r in sorted(G.reach(df, resolved(t), t["policies"]).collect(), key=lambda r: int(r.query_id))]


def test_aws_groups(spark):
    doc = {"SecurityGroups": [{"GroupId": "sg-1", "GroupName": "default", "IpPermissions": [
        {"IpProtocol": "tcp", "FromPort": 22, "ToPort": 22, "IpRanges": [{"CidrIp": "0.0.0.0/0"}]}, {"IpProtocol": "-1", "UserIdGroupPairs": [{"GroupId": "sg-2"}]}],
        "IpPermissionsEgress": [{"IpProtocol": "tcp", "FromPort": 0, "ToPort": 100, "IpRanges": [{"CidrIp": "10.0.0.0/8"}]}]}]}
    t = B.aws_rules(files(spark, json.dumps(doc)))
    r = {x.id: x for x in t["rules"].collect()}
    assert r["sg-1:IpPermissions[0]"].services == ["tcp/22"] and r["sg-1:IpPermissions[1]"].services == ["any"] and r["sg-1:IpPermissionsEgress[0]"].source == ["sg-1"]
    assert t["policies"].first().unordered and t["policies"].first().untrusted_zones == ["sg-1"]
    assert ask(spark, t, {"destination": "sg-1"}, {"destination": "sg-1", "port": 80}) == [True, False]
    assert {x.name: x.state for x in G.unresolved(G.resolve_objects(t["objects"], t["members"])).collect()} == {"sg-2": "UNSUPPORTED"}


def test_azure_priorities_and_tags(spark):
    rule = lambda n, p, **k: {"name": n, "priority": p, "direction": "Inbound", "access": "Allow", "protocol": "Tcp", "sourceAddressPrefix": "*", "destinationAddressPrefix": "*", "destinationPortRange": "22", **k}
    doc = [{"name": "nsg", "securityRules": [rule("late", 300), rule("early", 100, access="Deny", sourceAddressPrefix="Internet"), rule("tagged", 200, sourceAddressPrefix="Storage"), rule("udp", 250, protocol="*", destinationPortRange="53")]}]
    t = B.azure_rules(files(spark, json.dumps(doc)))
    r = t["rules"].orderBy("ord").collect()
    assert [x.id for x in r] == ["nsg:early", "nsg:tagged", "nsg:udp", "nsg:late"] and r[2].services == ["tcp/53", "udp/53"] and r[0].destination_zones == ["nsg"]
    single = B.azure_rules(files(spark, json.dumps(doc[0])))
    assert single["rules"].count() == 4


def test_gcp_deny_before_allow_and_unstated_source(spark):
    doc = [{"name": "a", "network": "x/net1", "direction": "INGRESS", "priority": 1000, "allowed": [{"IPProtocol": "tcp", "ports": ["22"]}], "sourceRanges": ["0.0.0.0/0"]},
           {"name": "b", "network": "x/net1", "direction": "INGRESS", "priority": 1000, "denied": [{"IPProtocol": "all"}], "sourceRanges": ["10.0.0.0/8"], "disabled": True}, {"name": "c", "network": "x/net1", "allowed": [{"IPProtocol": "icmp"}]}]
    t = B.gcp_rules(files(spark, json.dumps(doc)))
    r = t["rules"].orderBy("ord").collect()
    assert [x.id for x in r] == ["net1:b", "net1:a", "net1:c"] and not r[0].enabled and r[2].source == ["unstated-source"]


def test_iptables_sides_and_default(spark):
    lines = S.explode_lines(files(spark, ":INPUT BLOCK [0:0]\n-A INPUT -p tcp -s 10.0.0.0/8 --dport 22 -j ACCEPT\n-A OUTPUT -p udp -d 8.8.8.8 --sport 53 -j DROP"))
    t = B.iptables_rules(lines)
    r = t["rules"].orderBy("id").collect()
    assert r[0].source == ["10.0.0.0/8"] and r[0].services == ["tcp/22"] and r[0].action == "allow" and r[1].destination == ["8.8.8.8"] and r[1].action == "deny"
    assert t["policies"].first().default_action_observed


def test_keyvalue_tables(spark):
    kv = {"addrObjId_1": "web", "addrObjType_1": "1", "addrObjIp1_1": "10.0.0.5", "addrObjIp2_1": "10.0.0.9", "addrObjId_2": "grp", "addrObjType_2": "8", "addro_atomToGrp_0": "web", "addro_grpToGrp_0": "grp", "svcObjId_1": "ssh", "svcObjType_1": "1",
          "svcObjIpType_1": "6", "svcObjPort1_1": "22", "svcObjPort2_1": "22", "zoneObjId_1": "WAN", "policyName_3": "p", "policyAction_3": "2", "policyEnabled_3": "1", "policySrcNet_3": "grp", "policyDstSvc_3": "ssh", "policySrcZone_3": "WAN", "policyHitCount_3": "0", "policyPriority_3": "7"}
    recs = S.read_keyvalue_export(files(spark, "&".join(f"{k}={v}" for k, v in kv.items())), redact=False)
    t = B.keyvalue_rules(S.last_values(recs))
    r = t["rules"].first()
    assert (r.id, r.name, r.ord, r.action, r.hit_count, r.destination) == ("policy_3", "p [IPv4#3]", 7, "allow", 0, ["any"])
    assert resolved(t).first().src == ["10.0.0.5-10.0.0.9"] and t["policies"].first().untrusted_zones == ["WAN"]


def test_block_form_policies(spark):
    text = '''config firewall address
 edit "web"
  set subnet 10.1.2.3 255.255.255.0
 next
end
config firewall service group
 edit "svc"
  set member "HTTP" "HTTPS"
 next
end
config system interface
 edit "port1"
  set role wan
 next
end
config firewall policy
 edit 9
  set srcintf "port1"
  set dstaddr "web"
  set service "svc"
  set action accept
 next
 edit 3
  set action accept
  set schedule "night"
 next
end'''
    t = B.fortios_rules(S.read_block_config(S.explode_lines(files(spark, text))))
    r = t["rules"].orderBy("ord").collect()
    assert [x.id for x in r] == ["policy:9", "policy:3"] and r[1].program == "schedule:night" and r[0].source == ["any"] and r[0].destination == ["web"]
    x = {y.id: y for y in resolved(t).collect()}["policy:9"]
    assert x.dst == ["10.1.2.0/24"] and sorted(x.svc) == ["tcp/443", "tcp/80"]
    assert t["policies"].first().untrusted_zones == ["port1"]


def test_set_line_policies(spark):
    text = """set security address-book global address WEB 10.0.0.5/32
set security address-book global address-set ALL address WEB
set applications application myssh protocol tcp
set applications application myssh destination-port 22
set security zones security-zone untrust interfaces ge-0/0/0
set security policies from-zone untrust to-zone dmz policy allow-web match source-address any
set security policies from-zone untrust to-zone dmz policy allow-web match destination-address ALL
set security policies from-zone untrust to-zone dmz policy allow-web match application myssh
set security policies from-zone untrust to-zone dmz policy allow-web then permit
set security policies default-policy deny-all"""
    t = B.junos_rules(S.read_braces_config(S.explode_lines(files(spark, text))))
    r = t["rules"].first()
    assert (r.id, r.action) == ("untrust->dmz:allow-web", "allow") and "ALL" in r.destination and t["policies"].first().default_action_observed
    assert t["policies"].first().untrusted_zones == ["untrust"]


def test_xml_policies_and_malformed_files(spark):
    pan = """<config><devices><entry name="l"><vsys><entry name="v"><address><entry name="web"><ip-netmask>10.0.0.5</ip-netmask></entry></address><rulebase><security><rules>
<entry name="r1"><from><member>untrust</member></from><to><member>any</member></to><source><member>any</member></source><destination><member>web</member></destination><service><member>service-https</member></service><application><member>any</member></application><action>allow</action></entry>
<entry name="r2"><application><member>ssl</member></application><action>allow</action></entry></rules></security></rulebase></entry></vsys></entry></devices></config>"""
    both = spark.createDataFrame([("d", pan), ("bad", "<a><b></a>")], "device_id string, content string")
    recs = S.read_xml_leaves(both)
    assert recs.where("device_id = 'bad' and error is not null").count() == 1
    t = B.panos_rules(recs.where("error is null"))
    r = t["rules"].orderBy("ord").collect()
    assert [x.id for x in r] == ["rulebase:r1", "rulebase:r2"] and r[1].program == "app-id:ssl" and r[0].source_zones == ["untrust"]
    jun = """<rpc-reply><configuration><security><policies><policy><from-zone-name>trust</from-zone-name><to-zone-name>untrust</to-zone-name><policy><name>p1</name><match><source-address>any</source-address><destination-address>any</destination-address>
<application>junos-ssh</application></match><then><permit/></then></policy></policy><default-policy><deny-all/></default-policy></policies></security></configuration></rpc-reply>"""
    j = B.junos_xml_rules(S.read_xml_leaves(files(spark, jun)))
    assert j["rules"].first().id == "trust->untrust:p1"


def test_nesting_survives_long_files(spark):
    text = "config a\n" + "\n".join(f" edit {i}\n  set k v{i}\n next" for i in range(50)) + "\nend\nend\nconfig b\n set z 1\nend"
    lines = S.explode_lines(files(spark, text))
    whole = {(r.path, r.value) for r in S.read_block_config(lines).collect()}
    old = S.STRETCH
    try:
        d = lines.withColumn("opener", F.when(F.trim("text").rlike("^(config|edit) "), F.trim("text"))).withColumn("delta", F.when(F.trim("text").rlike("^(config|edit) "), 1).when(F.trim("text").isin("end", "next"), -1).otherwise(0))
        a = S.depth_after(d, ["device_id"], ["line"], "delta", stretch=7).orderBy("line").select("depth").collect()
        b = S.depth_after(d, ["device_id"], ["line"], "delta").orderBy("line").select("depth").collect()
        assert a == b
        x = S.last_seen(d, ["device_id"], ["line"], {"o": F.col("opener")}, stretch=7).orderBy("line").select("o").collect()
        y = S.last_seen(d, ["device_id"], ["line"], {"o": F.col("opener")}).orderBy("line").select("o").collect()
        assert x == y
    finally:
        S.STRETCH = old
    assert ("a/7/k", "v7") in whole and ("b/z", "1") in whole and len(whole) == 51


def test_sinks_round_trip(spark, tmp_path):
    snap = spark.createDataFrame([("k1", "2024-01-02", 1.0), ("k1", "2024-01-01", 2.0), ("k2", "2024-01-01", 3.0)], "device_key string, taken_at string, score double").withColumn("taken_at", F.to_timestamp("taken_at"))
    S.save_snapshot(snap.where("score > 1"), str(tmp_path / "h"))
    S.save_snapshot(snap.where("score <= 1"), str(tmp_path / "h"))
    assert [r.score for r in S.history(spark, str(tmp_path / "h"), "k1").collect()] == [2.0, 1.0]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.cfg").write_text("hostname x\n")
    (tmp_path / "c" / "b.cfg").write_bytes(b"\xff\xfe bad")
    got = {r.name: r.error for r in S.read_config_files(spark, str(tmp_path / "c")).collect()}
    assert got["a.cfg"] is None and got["b.cfg"] is not None


def test_configurations_of_many_suppliers_lie_in_one_folder(spark, tmp_path):
    import os
    from fenceline.plans import q_files
    from fenceline.session import checkpoint_dir
    spark.createDataFrame([(i, f"Supplier {i}", i % 5) for i in range(40)], "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    top = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    got = q_files.read_config_files(spark, str(tmp_path)).collect()
    assert sorted(r.k for r in got) == list(range(40)) and {(r.lines, r.error) for r in got} == {(2, None)}
    made = [f"{top}/{x}" for x in set(os.listdir(top)) - before]
    assert sum(len(ds) for m in made for _, ds, _ in os.walk(m)) <= 2 and sum(f.endswith(".txt") for m in made for _, _, fs in os.walk(m) for f in fs) == 40
