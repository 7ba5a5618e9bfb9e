"""Near-duplicate detection: MinHash bands propose, odd sketches estimate, full shingle sets decide.

1. Every text gets its set of word shingles, its MinHash samples and an odd sketch: the samples folded into a bitmap of parities.
   Texts with equal sets are one class, compared once.
2. Classes that share a band meet. The population count of two sketches' XOR estimates their similarity; pairs well below the threshold
   go, and of the rest only a spanning forest is passed on. Their components hold every link.
3. The members of a component compare their full sets, those estimated most similar first, until all that can be linked is linked.
Buckets and components beyond BLOCK members are split into blocks, and every pair of blocks is one task's work.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import words
from .graph import components
from .store import plain, written

SAMPLES, BANDS, ROWS, BITS = 128, 24, 4, 256
BLOCK = 4096
#: How far an estimate may lie below the threshold: over four standard deviations of samples and sketch together.
SLACK = 0.2
U = np.uint64
_SEEDS = words.mix(np.arange(1, SAMPLES + 1, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)


def shingle_sets(row: np.ndarray, h: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, hashes): the distinct word shingles of each text, sorted. A text of fewer words is one shingle, without words it has none."""
    counts = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(h)) - first[row]
    start = np.flatnonzero((place + width <= counts[row]) | ((counts[row] < width) & (place == 0)))
    x = np.full(len(start), width, U)
    for k in range(width):
        at = np.minimum(start + k, len(h) - 1) if len(h) else start
        inside = place[start] + k < counts[row[start]]
        x = np.where(inside, words.mix(x * U(0x9E3779B97F4A7C15) + h[at]), x)
    r = row[start]
    order = np.lexsort((x, r))
    x, r = x[order], r[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    x, r = x[new], r[new]
    return np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n_rows))]), x


def samples(cuts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """MinHash samples, a row for each set (empty sets: all ones)."""
    n = len(cuts) - 1
    out = np.full((n, SAMPLES), ~U(0), U)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        at = cuts[:-1][full]
        for j in range(SAMPLES):
            v = (x ^ _SEEDS[j]) * _SEEDS[-1 - j]
            v ^= v >> U(29)
            v *= _SEEDS[j]
            out[full, j] = np.minimum.reduceat(v, at)
    return out


def odd_sketches(s: np.ndarray) -> np.ndarray:
    """Parity bitmaps of (place, sample), as rows of 64-bit words."""
    bit = (words.mix(s + np.arange(1, s.shape[1] + 1, dtype=U) * U(0xA0761D6478BD642F)) % U(BITS)).astype(np.int64)
    flat = np.bincount((np.arange(len(s))[:, None] * BITS + bit).ravel(), minlength=len(s) * BITS) & 1
    return np.packbits(flat.astype(np.uint8).reshape(len(s), BITS), axis=1).view(U)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of a sketch to others: the size of the samples' difference from the odd bits of the XOR."""
    odd = np.bitwise_count(many ^ one).sum(axis=1)
    gone = np.log(np.maximum(1 - 2 * odd / BITS, 1e-9)) / np.log(1 - 2 / BITS)
    return 1 - gone / (2 * SAMPLES)


def band_keys(s: np.ndarray) -> np.ndarray:
    out = np.empty((len(s), BANDS), U)
    for b in range(BANDS):
        x = np.full(len(s), b + 1, U)
        for k in range(ROWS):
            x = words.mix(x * U(0x9E3779B97F4A7C15) + s[:, b * ROWS + k])
        out[:, b] = x
    return out


def _binary(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(a.shape[1] * a.itemsize), len(a), [None, pa.py_buffer(a)]).cast(pa.binary())


def signed(docs: DataFrame, text: str, width: int) -> DataFrame:
    """docs with __rid (a number of the row), __n (set size), __node (the set's class), __bands and __sketch."""
    own = [("__rid", T.LongType()), ("__n", T.LongType()), ("__node", T.BinaryType()), ("__bands", T.ArrayType(T.LongType())), ("__sketch", T.BinaryType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(*f) for f in own]])
    at = docs.columns.index(text)

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, _, row, _, _, h in words.hashed_words(batch.column(at)):
                part = batch.slice(i, j - i)
                cuts, x = shingle_sets(row, h, j - i, width)
                n = np.diff(cuts)
                s = samples(cuts, x)
                node = np.zeros((j - i, 2), U)
                for k in range(2):
                    v = words.mix(x + U(k + 11))
                    total = np.concatenate([np.zeros(1, U), np.cumsum(v)])
                    node[:, k] = total[cuts[1:]] - total[cuts[:-1]]
                keys = band_keys(s)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rid + np.arange(j - i)), pa.array(n.astype(np.int64)), _binary(node), lists, _binary(odd_sketches(s))], names=schema.names)
                rid += j - i

    return docs.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of batches sorted by them; only runs of two rows and more."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = np.concatenate([[0], cut, [t.num_rows]])
        for a, b in zip(edges[:-2], edges[1:-1]):
            if b - a > 1:
                yield t.slice(a, b - a)
        held = t.slice(edges[-2])
    if held is not None and held.num_rows > 1:
        yield held


def split(rows: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """rows with __i and __j: a group of more than `block` rows is dealt to blocks, and every two of these meet as one (by, __i, __j)."""
    big = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > block).select(by, F.ceil(F.col("__c") / block).alias("__k"))
    own = F.pmod(F.xxhash64("__node", F.lit(5)), F.col("__k"))
    dealt = rows.join(big, by, "left").withColumn("__k", F.coalesce("__k", F.lit(1))).withColumn("__own", own)
    met = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    return met.select(*rows.columns, F.least("__own", "__other").alias("__i"), F.greatest("__own", "__other").alias("__j"))


def _sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("__sketch").to_pylist()), U).reshape(t.num_rows, BITS // 64)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def edges(self, nodes: list[bytes]) -> pa.RecordBatch:
        pairs = [(nodes[i], nodes[self.root(i)]) for i in range(len(nodes)) if self.root(i) != i]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])


def proposed(t: pa.Table, floor: float) -> pa.RecordBatch:
    """A spanning forest of a bucket's pairs that are estimated at `floor` or more."""
    nodes, s = t.column("__node").to_pylist(), _sketches(t)
    forest, left = Forest(len(nodes)), np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near = similarity(s[p], s[left]) >= floor
            for q in left[near]:
                forest.join(int(p), int(q))
            queue += list(left[near])
            left = left[~near]
    return forest.edges(nodes)


def confirmed(nodes: list[bytes], s: np.ndarray, sets: list[np.ndarray], percent: int, floor: float) -> pa.RecordBatch:
    """Stars of the sets linked by full comparison: 100 * intersection >= percent * union."""
    forest = Forest(len(nodes))
    size = np.array([len(x) for x in sets])
    for i in range(1, len(nodes)):
        est = similarity(s[i], s[:i])
        able = (est >= floor) & (100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i]))
        pick = np.flatnonzero(able)
        for j in pick[np.argsort(-est[pick], kind="stable")]:
            if forest.root(i) != forest.root(int(j)):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    forest.join(i, int(j))
    return forest.edges(nodes)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 2, percent: int = 80) -> DataFrame:
    """docs with __n_shingles, __component (smallest key reachable over links, itself included) and __first (one row of each component).

    Words are runs of other than ASCII white space with A-Z in lower case. Texts that are null or without words have no shingles and are
    linked with nothing: each is its own component. Rows with a null key take part; their component is null unless linked to a key.
    Equal rows are linked; exactly one row of a component is __first. Whole texts are read. Columns keep their names and values.
    """
    floor = percent / 100 - SLACK
    renamed, names = plain(docs)
    t, k = names[text], names[key]
    rows = written(signed(renamed, t, width), "signed")
    one = F.min(F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("key"), F.col("__rid").alias("rid")))
    classes = written(rows.where("__n > 0").groupBy("__node").agg(one.alias("first"), F.max(F.struct("__bands", "__sketch")).alias("s")).select("__node", "first", "s.__bands", "s.__sketch"), "classes")

    band = classes.select("__node", "__sketch", F.explode("__bands").alias("__band"))
    shared = split(band, "__band").repartition("__band", "__i", "__j").sortWithinPartitions("__band", "__i", "__j")

    def meet(batches):
        for g in groups(batches, ["__band", "__i", "__j"]):
            yield proposed(g, floor)

    candidate = components(shared.select("__band", "__i", "__j", "__node", "__sketch").mapInArrow(meet, "a binary, b binary"))
    member = classes.join(candidate, F.col("__node") == F.col("node")).select("__node", "__sketch", F.col("root").alias("__root"), F.col("first.rid").alias("__rid"))
    met = split(member, "__root").join(rows.select("__rid", F.col(t).alias("__text")), "__rid")
    met = met.select("__root", "__i", "__j", "__node", "__sketch", "__text").repartition("__root", "__i", "__j").sortWithinPartitions("__root", "__i", "__j", "__node")

    def settle(batches):
        for g in groups(batches, ["__root", "__i", "__j"]):
            sets: list[np.ndarray] = []
            for i, j, _, row, _, _, h in words.hashed_words(pa.concat_arrays(g.column("__text").chunks)):
                cuts, x = shingle_sets(row, h, j - i, width)
                sets += [x[a:b] for a, b in zip(cuts, cuts[1:])]
            yield confirmed(g.column("__node").to_pylist(), _sketches(g), sets, percent, floor)

    linked = components(met.mapInArrow(settle, "a binary, b binary"))
    owner = classes.select("__node", "first").join(linked, F.col("__node") == F.col("node"), "left").withColumn("__root", F.coalesce("root", "__node"))
    least = owner.groupBy("__root").agg(F.min("first").alias("top"))
    named = written(owner.select("__node", "__root").join(least, "__root").select("__node", F.col("top.key").alias("__component"), F.col("top.rid").alias("__top")), "named")
    out = rows.drop("__bands", "__sketch").join(named, "__node", "left")
    alone = F.col("__n") == 0
    out = out.select(*[F.col(names[c]).alias(c) for c in docs.columns], F.col("__n").alias("__n_shingles"), F.when(alone, F.col(k)).otherwise(F.col("__component")).alias("__component"),
                     (alone | (F.col("__top") == F.col("__rid"))).alias("__first"))
    return out


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each group of near-duplicates; the one has the smallest key. Defaults: five words, 0.8."""
    return near_duplicates(docs, text, key, width, percent).where("__first").select(*docs.columns)


#: The same question by comparing all sets, in plain SQL.
SQL = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) ELSE w END) AS x FROM d), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(doc_id, met) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.met)
 SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(met) AS component_id, r.doc_id = min(met) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether a document is its component's first, on two-word shingles at a similarity of 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = near_duplicates(docs)
    return got.select("doc_id", F.col("__n_shingles").alias("n_shingles"), F.col("__component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("__component")).alias("kept"))
