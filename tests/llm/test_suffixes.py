"""Repeated strings against a dictionary of all windows."""
import hashlib
import random

from pyspark.sql import functions as F

from fenceline.llm import suffixes


def brute(rows, length=50):
    """(n_bytes, removed, spans, kept) of each row in order."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if i is not None and (w not in least or least[w] > i):
                least[w] = i
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and least[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = [k for k in range(len(b) + 1) if (k < len(b) and gone[k]) != (k > 0 and bool(gone[k - 1]))]
        out.append((i, len(b), tuple(zip(spans[::2], spans[1::2])), bytes(x for x, y in zip(b, gone) if not y)))
    return out


def same(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffixes.repeats(docs, **kw).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, kw.get("length", 50)), key=key)


def test_planted_passages_of_all_lengths_are_found_exactly(spark, prose):
    r = random.Random(4)
    shared = [prose(900 + i, 40) for i in range(12)]
    rows = []
    for i in range(150):
        parts = [prose(i, r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, len(p) - 1)
            parts += [p[a : a + r.randint(40, 120)], prose(1000 + i, r.randint(0, 9))]
        rows.append((r.randint(0, 400), r.choice(["", " ", "\n", "é"]).join(parts)))
    rows += [(i, shared[0]) for i in range(3, 90, 4)]  # copies of one text, and of a run of one byte
    rows += [(i, "a" * (48 + i)) for i in range(6)] + [(77, "a" * 500), (78, "ab" * 300)]
    for chunk in (1, 3000, 1 << 22):
        same(spark, rows, chunk_bytes=chunk)
    same(spark, rows, length=1, chunk_bytes=9000)
    same(spark, rows, length=7, chunk_bytes=9000)


def test_repeats_of_odd_rows(spark, odd_docs, none):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    same(spark, rows)
    assert suffixes.repeats(odd_docs).columns == ["doc_id", "n_bytes", "spans", "kept"]
    assert suffixes.repeats(none).count() == 0
    same(spark, [(1, "é" * 60), (2, "x" + "é" * 25), (3, "é" * 24 + "e" * 10), (4, None), (5, "")])


def test_query_columns(spark, tmp_path, prose):
    rows = [(i, prose(i % 3, 50) + prose(i, 5)) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.op13_repeated_strings(spark, str(tmp_path)).collect()}
    assert got == {i: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows)}
