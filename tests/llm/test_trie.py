"""The prefix trie and source divergence against plain Python."""
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from fenceline.llm import skyband, trie

WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in turns.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = set()
    for s, m in members.items():
        below = [x for x in members if x[: len(s)] == s]
        kids = [x for x in below if len(x) == len(s) + 1]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(s))))
        leaves = sum(1 for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below))
        out.add((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk():
    rows = []
    for c in range(-3, 130):
        if c in (40, 41):
            continue
        n = (c * 7) % 6 + 1
        rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {(c // 40) if t < 3 else c % 9} words here" * (1 + t % 2)) for t in range(n)]
    rows += [(200, t, "user", f"same {t}") for t in range(30)] + [(c, t, "user", f"same {t}") for c in (201, 205, 213) for t in range(30 + c % 2)]  # long copies
    rows += [(300, None, None, "first"), (300, 0, "user", None), (300, 0, "user", None), (300, 0, "a", "tie"), (300, 0, "a", "tie two"), (None, 1, "user", "nobody"), (301, 5, "", "")]
    rows += [(c, 0, "user", "x") for c in (403, 405, 406, 407)]  # alone in their twenty: some are left without a turn
    return rows


@pytest.mark.parametrize("cells, stretch", [(1 << 24, 4096), (64, 4), (8, 1)])
def test_trie_is_the_brute_one_however_coarse_the_sketch(spark, monkeypatch, cells, stretch):
    monkeypatch.setattr(trie, "MAX_CELLS", cells)
    monkeypatch.setattr(trie, "STRETCH", stretch)
    rows = talk()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, depth int").repartition(5)
    got = trie.prefix_trie(*trie.rebuilt(trie.numbered(docs)))
    assert got.columns == COLS
    assert [tuple(r) for r in got.collect() if r.depth == 0] == [r for r in brute_trie(rows) if r[1] == 0]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_tails_are_proven_by_the_sketch(spark):
    turns = trie.numbered(spark.createDataFrame(talk(), "conv_id long, turn long, role string, text string"))
    rows = trie.prefixes(turns)
    cells, bits = trie.sketched(rows, rows.count())
    known = trie.screened(rows, cells, bits).collect()
    n = collections.Counter((r.d1, r.d2) for r in known)
    assert all(n[r.d1, r.d2] == 1 for r in known if r.alone)
    assert sum(r.alone for r in known) > 0.9 * sum(n[r.d1, r.d2] == 1 for r in known)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(*trie.rebuilt(trie.numbered(none))).count() == 0


def brute_divergence(rows, top=200):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(low))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df, total = collections.Counter(t for d in mine for t in set(d[2])), collections.Counter(t for d in mine for t in d[2])
        kept = [t for t in df if df[t] >= 3]
        sources = sorted({d[1] for d in mine})
        count = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= 3) for s in sources}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(count[s]) for s in sources}, share({t: total[t] for t in kept})
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            far = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            own = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(far)), ("term", sorted(own)[:top])):
                out |= {(lang, s, part, x.decode(), -v, i) for i, (v, x) in enumerate(items, 1)}
    return out


def test_divergence_is_the_brute_one(spark, odd_docs, none, vocabulary):
    r = np.random.default_rng(3)
    words_ = [*vocabulary[:600], "É", "Zoë", "日本", "a1b", "It's", "\x7fdel", "under_score"]
    rows = []
    for i in range(260):
        at = np.minimum(r.zipf(1.4, int(r.integers(0, 90))) - 1 + (i % 5) * 7, len(words_) - 1)
        rows.append((" ".join(words_[k].upper() if k % 3 else words_[k] for k in at), ["en", "de", None][i % 3], [f"s{i % 5}", None, "hot"][min(i % 4, 2)]))
    rows += [(None, "en", "empty"), ("", "xx", "one"), ("12 34", "xx", "two"), *[("a b", "yy", "only")] * 3]
    docs = spark.createDataFrame([(*x, "t", 5) for x in rows], "text string, lang string, source string, term string, n int").repartition(6)
    for top in (200, 7):
        got = [tuple(x) for x in skyband.divergence(docs, top=top).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, top)
    odd = [tuple(x) for x in odd_docs.select("text", "lang", "source").collect()]
    assert {tuple(x) for x in skyband.divergence(odd_docs).collect()} == brute_divergence(odd)
    assert skyband.divergence(none).count() == 0


def test_skyband_keeps_those_that_few_dominate():
    r = np.random.default_rng(5)
    for n, k in ((0, 3), (1, 1), (1500, 5), (1500, 40)):
        c, t, rank = r.integers(1, 30, n), r.integers(1, 60, n), r.permutation(n)
        by = ((c[None, :] >= c[:, None]) & (t[None, :] <= t[:, None]) & (rank[None, :] < rank[:, None])).sum(axis=1)
        assert sorted(skyband.skyband(c, t, rank, k)) == list(np.flatnonzero(by < k))
