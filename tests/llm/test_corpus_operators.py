"""Packing, mixing, neighbours, passages, near-duplicates and the pipeline against plain Python."""
import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenceline.llm import ann, graph, mixing, near, packing, passages

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def check_packing(docs, rows, window=2048):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in docs)
    sequences, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        by[r.doc_id].append(r)
    padding = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s]))[:-1]
        n = sum(r.length for r in s)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    total = collections.Counter()
    for i, s in by.items():
        whole = collections.Counter(ids for (k, ids), c in want.items() if k == i for _ in range(c))
        if len(s) and sum(whole.values()) == 1:
            s.sort(key=lambda r: r.start)
            assert tuple(np.concatenate([np.frombuffer(r.ids, "<u4") for r in s])) == next(iter(whole))
            assert [r.start for r in s] == list(np.cumsum([0] + [r.length for r in s]))[:-1]
        assert sum(r.length for r in s) == sum(len(x) * c for x, c in whole.items())
        total[i] += 1
    assert set(total) == {i for i, _ in want}
    return padding


def test_packing_is_a_round_trip(spark, odd_docs, none, prose):
    more = [(50 + i, prose(100 + i, 30 + 37 * i % 900)) for i in range(60)] + [(200, "a <|endoftext|> b"), (201, "<|endoftext|>")]
    d = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    docs = [tuple(r) for r in d.collect()]
    for kw in ({}, {"shard_tokens": 5000, "task_tokens": 20000}, {"window": 64, "shard_tokens": 3000}):
        assert check_packing(docs, packing.pack(d, **kw).collect(), kw.get("window", 2048)) == 0
    assert packing.pack(none).count() == 0


def test_packing_puts_lexical_neighbours_together():
    r = random.Random(2)
    docs = [np.array([1000 * (i % 4) + r.randrange(200) for _ in range(32)]) for i in range(80)]
    done, _, left = packing.pack_shard(docs, [0] * 80, 0, window=128)
    assert not left and sum(p.length for p in done) == 80 * 32
    pure = collections.defaultdict(set)
    for p in done:
        pure[p.sequence].add(p.row % 4)
    assert all(len(v) == 1 for v in pure.values())


def test_powers_of_two_keep_every_id():
    pieces = [packing.Piece(0, 5, 100, 0, 0), packing.Piece(1, 0, 31, 0, 100)]
    out, n = packing.powers_of_two(pieces, 7)
    assert [(p.row, p.start, p.length, p.sequence, p.offset) for p in out] == [(0, 5, 100, 7, 0), (1, 0, 28, 7, 100), (1, 28, 2, 8, 0), (1, 30, 1, 9, 0)] and n == 10


def test_mixing_meets_its_targets(spark):
    rows = [(i, "big" if i < 600 else "mid" if i < 750 else "small", "w " * (1 + i % 7)) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = collections.Counter()
    for _, s, t in rows:
        size[s] += len(t.split())
    total = sum(size.values())
    got = mixing.mix(d, mixing.Target(max_epochs=3.0), block_docs=16).collect()
    seen, epochs = collections.Counter(), collections.Counter()
    for r in got:
        seen[r.source] += r["__n"]
        epochs[r.doc_id] += 1
    assert set(epochs) == set(range(800)) and max(epochs.values()) == 3 and max(epochs[i] for i in range(600)) == 1
    w = {r.source: r["__weight"] for r in got}
    assert sum(w.values()) == pytest.approx(1)
    a = got[0]["__exponent"]
    assert all(w[s] == pytest.approx((size[s] / total) ** a / sum((x / total) ** a for x in size.values())) for s in size)
    assert all(abs(seen[s] / sum(seen.values()) - w[s]) < 0.02 for s in size)
    got = mixing.mix(d, mixing.Target(entropy=0.9, budget=float(total)), block_docs=16).collect()
    w = {r.source: r["__weight"] for r in got}
    assert -sum(x * math.log(x) for x in w.values()) / math.log(3) == pytest.approx(0.9, abs=1e-3)
    assert sum(r["__n"] for r in got) <= total + 1e-6 and sum(r["__n"] for r in got) > 0.95 * total
    spent = {s: max(r["__place"] for r in got if r.source == s) for s in size}
    assert all(0 <= x <= 1 for x in spent.values())


def test_mixing_edges(odd_docs, none):
    got = mixing.mix(odd_docs, mixing.Target(max_epochs=1.5))
    assert got.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in odd_docs.collect()} and got.where("__epoch = 0").count() == odd_docs.count()
    assert mixing.mix(none, mixing.Target(entropy=0.5)).count() == 0


def test_neighbours_recall_and_scores(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((20, 24))
    v = np.concatenate([centres[r.integers(0, 20, 1500)] + 0.4 * r.standard_normal((1500, 24)), np.tile(centres[0], (300, 1))])
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] * 24]
    rows = [(i, x.tolist(), "a") for i, x in enumerate(v)] + [(2000 + 50 * i, x, "b") for i, x in enumerate(bad)] + [(None, v[0].tolist(), "c")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(d, F.col("vec_id") % 50 == 0, shard_rows=400).collect()
    n = np.sqrt((v * v).sum(1))
    found = collections.defaultdict(dict)
    for g in got:
        found[g.query_id][g["rank"]] = g
    hit = 0
    for q in range(0, 1800, 50):
        s = (v * v[q]).sum(1) / (n * n[q])
        s[q] = -9
        best = np.lexsort((np.arange(len(v)), -s))[:5]
        mine = [found[q][k] for k in range(1, 6)]
        hit += len({g.vec_id for g in mine} & set(best.tolist()))
        assert all(g.score == pytest.approx(s[g.vec_id], abs=1e-12) for g in mine)
        assert [(-g.score, g.vec_id) for g in mine] == sorted((-g.score, g.vec_id) for g in mine)
    assert set(found) == set(range(0, 1800, 50)) and hit >= 0.9 * 5 * len(found)
    few = ann.search(d.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert {g.vec_id for g in few} == {1, 2}
    assert ann.search(d.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [128, 384, 768])
def test_neighbours_recall_in_whole_shards_without_clusters(size):
    r = np.random.default_rng(size)
    v = r.standard_normal((2 * ann.SHARD_ROWS, size))
    n = np.sqrt((v * v).sum(1))
    ids = np.arange(len(v))
    shards = [ann.Shard(ids[i::2], v[i::2]) for i in range(2)]
    hit, asked = 0, range(0, len(v), 820)
    for q in asked:
        s = v @ v[q] / (n * n[q])
        s[q] = -9
        got = sorted((x for shard in shards for x in shard.nearest(q, v[q], 5)), key=lambda x: (-x[1], x[0]))[:5]
        hit += len({i for i, _ in got} & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.95 * 5 * len(asked)


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(6)
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(70)] + [("s000", f"s{i:03}") for i in range(1, 300)] + [("x", "x"), ("y", "z"), ("z", "y")]
    r.shuffle(edges)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {v for k, v in got.items() if k[0] == "p"} == {"p000"} and {v for k, v in got.items() if k[0] == "s"} == {"s000"} and got["z"] == "y" and "x" not in got and len(got) == 373


def brute_components(docs, width, percent):
    sets = []
    for _, t in docs:
        w = [lower(x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    keys = collections.defaultdict(list)
    for i, (k, _) in enumerate(docs):
        keys[root(i)].append(k)
    least = {g: min((k for k in v if k is not None), default=None) for g, v in keys.items()}
    return sorted(((k, len(s), least[root(i)]) for i, ((k, _), s) in enumerate(zip(docs, sets))), key=repr)


@pytest.fixture(scope="module")
def copies(spark, odd_docs, prose):
    """Groups of near copies at similarities around the threshold, one group as a chain of small edits."""
    r = random.Random(8)
    rows = []
    for g in range(12):
        w = prose(500 + g, 90).split()
        for c in range(12):
            if g % 2:
                w = list(w)
            v = list(w)
            for _ in range(r.randint(0, 7)):
                v[r.randrange(len(v))] = f"edit{r.randrange(10**6)}"
            rows.append((1000 + 100 * g + c, " ".join(v)))
            w = v if g % 3 == 0 else w
    return odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_duplicates_match_brute_force(copies):
    docs = [tuple(r) for r in copies.collect()]
    for width in (2, 5):
        got = near.near_duplicates(copies, width=width).collect()
        assert sorted(((r.doc_id, r["__n_shingles"], r["__component"]) for r in got), key=repr) == brute_components(docs, width, 80)
        first = collections.Counter((r["__component"], r["__n_shingles"] > 0 or r.doc_id) for r in got if r["__first"])
        assert max(first.values()) <= 2  # texts without words stand alone


def test_near_duplicates_in_blocks(copies, monkeypatch):
    monkeypatch.setattr(near.split, "__defaults__", (3,))
    docs = [tuple(r) for r in copies.collect()]
    got = near.near_duplicates(copies).collect()
    assert sorted(((r.doc_id, r["__n_shingles"], r["__component"]) for r in got), key=repr) == brute_components(docs, 2, 80)


def test_near_duplicates_edges(odd_docs, none):
    kept = near.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8]
    assert near.near_duplicates(none).count() == 0


def test_odd_sketches_estimate_high_similarity():
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 2**63, 2000).astype(np.uint64))
    for share in (0.8, 0.9, 1.0):
        k = int(len(x) * (1 - share) / (1 + share))
        a, b = x[: len(x) - k], x[k:]
        s = near.samples(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
        sk = near.odd_sketches(s)
        assert abs(near.similarity(sk[0], sk[1:])[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


def test_passages_exact_and_fuzzy(spark, odd_docs, none):
    r = random.Random(3)
    voc = [f"w{i}" for i in range(4000)]
    w = lambda n: [r.choice(voc) for _ in range(n)]
    p = w(60)
    fuzzy = list(p)
    fuzzy[17], fuzzy[38] = "e1", "e2"
    docs = [(0, w(100) + p + w(50)), (1, w(10) + p), (2, w(300)), (3, p + w(5)), (4, w(7) + fuzzy + w(30)), (5, w(4) + p[:30] + ["ins"] + p[30:] + w(9)), (6, p[:40] + w(20)), (7, w(60) + ["a"] * 400)]
    d = spark.createDataFrame([(i, " ".join(t).upper() if i == 3 else " ".join(t)) for i, t in docs], "doc_id long, text string")
    got = passages.repeated_passages(d).collect()
    spans = collections.defaultdict(set)
    for g in got:
        assert g.identity >= 0.8 and min(g.end_word - g.start_word, g.other_end - g.other_start) >= 50
        spans[g.doc_id].add((g.start_word, g.end_word))
        spans[g.other_doc_id].add((g.other_start, g.other_end))
    want = {0: (100, 160), 1: (10, 70), 3: (0, 60), 4: (7, 67), 5: (4, 65)}
    assert set(spans) == set(want) and all(any(abs(s[0] - want[i][0]) <= 1 and abs(s[1] - want[i][1]) <= 1 for s in spans[i]) for i in want)
    assert passages.repeated_passages(none).count() == 0
    same = passages.repeated_passages(odd_docs).collect()
    assert {g.doc_id for g in same} | {g.other_doc_id for g in same} == {1, 2, None}


def test_chains_take_order_and_gaps_into_account():
    a = np.array([0, 4, 9, 30, 31, 200])
    b = np.array([50, 54, 59, 10, 82, 260])
    assert passages.chains(a, b)[0] == [0, 1, 2, 4]


def test_pipeline_stages(spark, tmp_path, prose):
    import corpus_pipeline as c

    secret = ' token = "' + "0f1e2d3c4b5a6978" * 2 + '" '
    rows = [(i, prose(900 + i, 150) + (secret if i == 7 else ""), "en", f"s{i % 3}" if i < 40 else "s0", 1) for i in range(60)]
    rows += [(100, rows[3][1], "en", "s1", 1), (101, "spam " * 400, "en", "s1", 1), (102, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in c.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    assert {r.doc_id for r in seen[0].collect()} == set(range(60)) | {100}
    assert {r.doc_id for r in seen[1].collect()} == set(range(60))
    assert "<secret>" in next(r.text for r in seen[2].collect() if r.doc_id == 7) and seen[2].count() == 60
    assert {r.doc_id for r in seen[3].collect()} == set(range(60)) and seen[3].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert check_packing([(r.doc_id, r.text) for r in seen[3].collect()], seen[4].collect()) == 0
    assert c.run(spark, str(tmp_path)).count() == seen[4].count()


def test_passages_made_of_pieces_that_others_hold_too(spark, prose):
    """Both halves of a passage stand in other documents as well; those who hold the whole still find one another, and every holder finds someone."""
    rows, pairs, halves = [], [], {}
    for k in range(12):
        one, two = prose(7000 + k, 45), prose(7100 + k, 45)
        at = 100 * k
        for i, t in enumerate([one, one + " " + two, one + " " + two, two, prose(7200 + k, 60)]):
            rows.append((at + i, f"{prose(7300 + 10 * k + i, 30)} {t} {prose(7400 + 10 * k + i, 30)}"))
        pairs.append((at + 1, at + 2))
        halves |= {at: 45, at + 1: 90, at + 2: 90, at + 3: 45}
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = passages.repeated_passages(d, min_words=40).collect()
    whole = {tuple(sorted((r.doc_id, r.other_doc_id))) for r in got if r.end_word - r.start_word >= 85}
    assert len(whole & set(pairs)) >= 11
    assert {r.doc_id for r in got} == set(halves)
