"""Identification: ties, floors, structure before signatures, taught signatures, packs and grammars."""
import base64

from fenceline.operators import identify as I


def rows(spark, *contents):
    return spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "device_id string, content string")


def test_fingerprint_order_floor_and_details(spark):
    export = "shortProdName=NSA%203700&buildNum=7.1&serialNumber=0017C5ABCDEF&firewallName=fw1&" + "x" * 60
    late = "\n" * 500 + "ASA Version 9.8(2)\nhostname late\n"
    d = rows(spark, "aaa new-model", "aaa new-model\nservice password-encryption", '{"DEVICE_METADATA": {}}', '{"unknown": 1}', "<rpc-reply><host-name>j</host-name></rpc-reply>", export,
             base64.b64encode(export.encode()).decode(), late, None, '[{"kind": "compute#firewall"}]', "{ not json\n  config system global\nset hostname \"f\"\n")
    got = {r.device_id: r for r in I.fingerprint(d).collect()}
    assert [(got[str(i)].platform, got[str(i)].confidence) for i in range(11)] == [
        ("UNKNOWN", 0.25), ("cisco_iosxe_router", 0.5), ("sonic", 1.0), ("UNKNOWN", 0.0), ("juniper_srx_xml", 1.0), ("sonicwall_sonicos", 1.0), ("sonicwall_sonicos", 1.0),
        ("cisco_asa", 1.0), ("UNKNOWN", 0.0), ("gcp_firewall", 1.0), ("fortinet_fortios", 1.0)]
    assert (got["5"].model, got["5"].serial, got["6"].hostname, got["7"].hostname, got["10"].hostname) == ("NSA 3700", "0017C5ABCDEF", "fw1", "late", "f")


def test_taught_signatures_need_all_and_never_capture_known_files(spark):
    d = rows(spark, "acme os\nmode x", "acme os", "ASA Version 9.1\nacme os\nmode x", '{"acme": {"v": 1}}')
    taught = spark.createDataFrame([("acme", "a", "indented", "^acme"), ("acme", "a", "indented", "^mode"), ("aj", "a", "json", "$.acme.v")], "platform string, vendor string, reader string, signature string")
    assert {r.device_id: r.platform for r in I.fingerprint(d, taught).collect()} == {"0": "acme", "1": "UNKNOWN", "2": "cisco_asa", "3": "aj"}


def test_select_pack_prefers_the_reader(spark):
    dev = spark.createDataFrame([("1", "p", "v", "r2"), ("2", "p", "v", "r9"), ("3", "q", "v", None), ("4", "z", "z", None)], "device_id string, platform string, vendor string, reader string")
    packs = spark.createDataFrame([("a", 1, "p", "v", "r1"), ("b", 2, "p", "v", "r2")], "pack string, ordinal int, platform string, vendor string, reader string")
    assert {r.device_id: r.pack for r in I.select_pack(dev, packs).collect()} == {"1": "b", "2": "a", "3": "a", "4": None}


def test_grammar_ranks(spark):
    d = rows(spark, "a {\nb;\n}\n" * 4, "config x\n  set a b\n  set c d\n  set e f\nend", "word", '{"a": 1}', None)
    got = {}
    for r in I.detect_grammar(d).orderBy("device_id", "rank").collect():
        got.setdefault(r.device_id, []).append((r.reader, round(r.confidence, 2)))
    assert got == {"0": [("braces", 0.67)], "1": [("fortinet_block", 1.0), ("indented", 0.9)], "2": [("indented", 0.15)], "3": [("json", 1.0)], "4": [("indented", 0.15)]}
