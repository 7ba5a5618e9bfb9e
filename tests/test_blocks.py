"""Block-wise ranking, the version index of vulnerability matching and two-level chains, against plain Python."""
import random

import numpy as np
from pyspark.sql import functions as F

from fenceline.functions import version as VV
from fenceline.operators import blocked, extended as E, retrieval as Q


def test_dense_rank_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocked, "QUESTION_BLOCK", 3)
    monkeypatch.setattr(blocked, "ROW_BLOCK", 16)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 8)).round(2)
    v[50:60] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    d = spark.createDataFrame([*rows, (900, None), (901, [1.0, None] + [0.0] * 6), (902, [1.0, 2.0]), (None, [1.0] * 8)], "doc_id int, embedding array<double>")
    q = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 40, 5)] + [(77, [2.0, 4.0]), (78, None)], "query_id int, embedding array<double>")
    got = [(r.query_id, r["rank"], r.doc_id) for r in Q.dense_rank(q, d, 12).orderBy("query_id", "rank").collect()]
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
    want = [(i, k + 1, int(j)) for i in range(0, 40, 5) for k, j in enumerate(sorted(range(90), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:12])]
    assert got == want + [(77, 1, 902)]
    assert Q.dense_rank(q, d.where("false"), 3).count() == 0 and Q.dense_rank(q.where("false"), d, 3).count() == 0


def test_bm25_over_many_blocks_is_the_best_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocked, "QUESTION_BLOCK", 2)
    monkeypatch.setattr(blocked, "ROW_BLOCK", 10)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i}", " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randint(0, 25)))) for i in range(80)] + [("e", ""), ("n", None), ("d7b", "w1 w2"), ("d7a", "w1 w2")]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6))) for i in range(7)] + [(8, "zz"), (9, None)], "query_id int, text string")
    pairs = {}
    for r in Q.bm25_scores(q, d).collect():
        pairs.setdefault(r.query_id, []).append((-round(r.bm25, 9), r.doc_id))
    got = {}
    for r in Q.bm25(q, d, 9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.bm25, r.doc_id))
    assert got == {i: sorted(x)[:9] for i, x in pairs.items()}
    keep = d.where("doc_id >= 'd5'").select("doc_id")
    only = [(r.query_id, r.doc_id) for r in Q.bm25(q, d, 4, keep).orderBy("query_id", "rank").collect()]
    assert only == [(i, x[1]) for i in sorted(pairs) for x in sorted(p for p in pairs[i] if p[1] >= "d5")[:4]]


def test_release_codes_keep_order_and_blocks_cover_ranges(spark):
    rng = random.Random(9)
    names = sorted({".".join(str(rng.choice([0, 1, 2, 9, 10, 32766, 32767, 40000, 20230115])) for _ in range(rng.randint(1, 6))) for _ in range(120)})
    df = spark.createDataFrame([(n,) for n in names], "v string").select("v", VV.version_key(F.col("v")).alias("k")).select("v", VV.release_code(F.col("k")).alias("c"))
    code = {r.v: r.c for r in df.collect()}
    pad = lambda v: [int(x) for x in v.split(".")] + [0] * (6 - len(v.split(".")))
    ordered = sorted(names, key=pad)
    assert all(code[a] <= code[b] for a, b in zip(ordered, ordered[1:])) and len(set(code.values())) > 60
    last = (1 << VV.CODE_BITS) - 1
    probes = [0, 1, 5, 6, 7, 8, 1000, last - 1, last]
    spans = [(0, last), (0, 0), (5, 8), (6, 7), (1, last - 1), (7, last), (last, last)]
    for r in spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", VV.code_blocks(F.col("lo"), F.col("hi")).alias("b")).collect():
        for p in probes:
            assert sum(p >> b.level == b.at for b in r.b) == (1 if r.lo <= p <= r.hi else 0), (r.lo, r.hi, p)
    unread = spark.createDataFrame([("x",), ("99999999999999999999.1",), (None,)], "v string").select(VV.release_code(VV.version_key(F.col("v"))).alias("c"))
    assert all(r.c is None for r in unread.collect())


def test_cve_candidates_lose_no_match(spark):
    """Every release against every record, folded in the same way without an index."""
    rng = random.Random(4)
    t = "struct<criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>"
    sch = f"cve_id string, status string, configurations array<struct<operator:string,negate:boolean,nodes:array<struct<operator:string,negate:boolean,cpeMatch:array<{t}>>>>>"
    some = lambda *x: rng.choice([None, None, *x])

    def criterion():
        kind = rng.random()
        if kind < 0.25:
            return (f"cpe:2.3:h:acme:m{rng.randint(1, 3)}:-:*", None, None, None, None)
        if kind < 0.3:
            return (rng.choice(["cpe:2.3:o:acme", "cpe:2.3:h", ""]), None, None, None, None)
        ver = rng.choice(["*", "*", "*", "*", "7.2", "-", "odd"])
        return (f"cpe:2.3:o:acme:{rng.choice(['os', 'os', 'fw'])}:{ver}:*", some("7.0", "7.2.1", "bad"), some("7.1"), some("7.2-9", "8"), some("7.3", "9.1", "7.2-5"))

    def record(i):
        node = lambda: (rng.choice(["OR", "AND", None]), rng.random() < 0.12, [criterion() for _ in range(rng.randint(1, 3))])
        return (f"C{i}", rng.choice(["ok", "ok", "ok", "Rejected"]), [(rng.choice(["OR", "AND", None]), rng.random() < 0.08, [node() for _ in range(rng.randint(1, 2))]) for _ in range(rng.randint(0, 2))])

    c = spark.createDataFrame([record(i) for i in range(120)], sch)
    versions = ["7.0", "7.1", "7.2", "7.2.0-9", "7.2-3", "7.2.1", "7.3", "8.0.0", "9", "10.4", "odd", "99999999999999999999"]
    dev = [(f"d{i}-{m}-{p}", v, m, "o", "acme", p) for i, v in enumerate(versions) for m in ("M1", "m2", None) for p in ("os", "fw", "other")] + [("blank", "", "M1", "o", "acme", "os"), ("none", None, "M1", "o", "acme", "os"), ("twin", "7.2", "M1", "o", "acme", "os")]
    d = spark.createDataFrame(dev, "device_id string, version string, model string, part string, vendor string, product string")
    cond = E.cve_conditions(c.where("lower(status) != 'rejected'"))
    u = d.where("coalesce(version, '') != ''").select("device_id", VV.version_key(F.col("version")).alias("vk"), E.model_slug(F.col("model")).alias("slug"), F.col("part").alias("dp"), F.col("vendor").alias("dv"), F.col("product").alias("dprod"))
    every = u.withColumn("one", F.lit(1)).join(cond.withColumn("one", F.lit(1)), "one").withColumn("hold", E.condition_holds(F.col("vk"), F.col("slug"), F.col("dp"), F.col("dv"), F.col("dprod")))
    want = {(r.device_id, r.cve_id, r.affected) for r in E._fold_record(every, "device_id", "cve_id").where("affected is null or affected").collect()}
    got = [(r.device_id, r.cve_id, r.affected) for r in E.match_cve(d, c).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {x[2] for x in want} == {True, None}


def test_chain_over_stretches(spark):
    sch = "log_id int, seq int, field string, line string, platform string, vendor string, value string, approved_by string, approved_at string"
    base = spark.createDataFrame([(1, 0, "f", "l", "p", "v", "x", "me", "t")], sch)
    rows, prev = [], ""
    for i in range(9):
        one = base.withColumn("seq", F.lit(i * 2)).withColumn("prev_hash", F.lit(prev)).withColumn("record_hash", Q.record_hash()).first()
        rows.append(one)
        prev = one.record_hash
    df = spark.createDataFrame(rows)

    def check(x, width):
        r = Q.verify_chain(x, stretch=width).first()
        return r.intact, r.first_broken, r.records

    for width in (1, 3, 4, 7, 100):
        assert check(df, width) == (True, None, 9)
        assert check(df.where("seq != 8"), width) == (False, 10, 8)
        assert check(df.where("seq > 0"), width) == (False, 2, 8)
        assert check(df.withColumn("value", F.when(F.col("seq") == 6, "y").otherwise(F.col("value"))), width) == (False, 6, 9)
        assert check(df.withColumn("record_hash", F.when(F.col("seq") != 6, F.col("record_hash"))), width) == (False, 6, 9)
        assert check(df.withColumn("prev_hash", F.when(F.col("seq") != 10, F.col("prev_hash"))), width) == (False, 10, 9)
    assert Q.verify_chain(df.where("false")).count() == 0
