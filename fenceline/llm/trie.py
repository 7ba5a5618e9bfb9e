"""The prefix trie of conversations, with a count-min sketch that tells which prefixes need no grouping.

1. Turns become digests, numbered within their conversation; a prefix's digest is the XOR of its turns' digests, each taken with its place.
2. A count-min sketch of the prefix digests never estimates too low, so an estimate of one proves that one conversation alone has the prefix.
   What lies below such a prefix is that conversation's own tail: its nodes are written down where the row stands.
3. Only possibly shared prefixes are dealt by digest and grouped exactly. A wrong estimate costs a row more in that shuffle, nothing else.
4. Sums over subtrees run along conversations: a node's figures stand in the row of its smallest member, and that member passes all nodes above.

The sketch holds MAX_CELLS cells a row at most and saturates at two, so its merged form is ROWS * MAX_CELLS / 8 bytes or less whatever the input;
that is what the driver gets and sends to the tasks. Numbering and sums go in two levels, so a conversation may be longer than a task's share.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import words
from .store import written

ROWS, MAX_CELLS, SEGMENT = 3, 1 << 24, 1 << 16
#: Turns of a conversation whose sums are worked out together.
STRETCH = 4096
WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64
_NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, pos, t1, t2, words): each turn's place in its conversation from 0, digests of (role, text), and the words of its text.

    Turns are ordered by turn, null first; ties by role, then by the MD5 of the text. A null role or text is an empty one. Rows without a
    conversation are left out. `part` tells stretches of the order apart; places are counted within stretches and then over them.
    """
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), F.md5(x).alias("tie"), F.monotonically_increasing_id().alias("rid"),
        F.xxhash64(F.lit(1), r, x).alias("t1"), F.xxhash64(F.lit(2), r, x).alias("t2"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"), F.col("rid")]
    dealt = written(rows.repartitionByRange("conv", *order).select("*", F.spark_partition_id().alias("part")), "dealt")
    here = Window.partitionBy("conv", "part")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    at = dealt.select("conv", "part", "t1", "t2", "words", F.row_number().over(here.orderBy(*order)).cast("long").alias("at"))
    return at.join(runs, ["conv", "part"]).select("conv", "part", (F.col("at") - 1 + F.col("skip")).alias("pos"), "t1", "t2", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with the first h turns of conversation c - c % every in place of each one's own; h = crc32(decimal c) % most."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = F.col("conv") - F.col("conv") % every
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.withColumn("h", h).withColumn("base", base).join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = convs.select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m"))
    own = turns.join(convs.select("conv", "h", "m"), "conv").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    heads = turns.where((F.col("pos") < most - 1) & (F.col("conv") % every == 0)).withColumnRenamed("conv", "base").drop("part")
    lent = convs.where("m > 0").join(heads, "base").where("pos < m").withColumn("part", F.lit(-1))
    return own.select(*turns.columns).unionByName(lent.select(*turns.columns)), convs.select("conv")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, d1, d2, p1, p2, words, last): the digest of each prefix and of the one before it."""
    step = [F.xxhash64(F.lit(k + 2), "pos", "t1", "t2").alias(f"h{k}") for k in (1, 2)]
    rows = turns.select("conv", "part", "pos", "words", *step)
    upto, before = Window.partitionBy("conv", "part").orderBy("pos"), Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.max("pos").alias("top"))
    runs = runs.select("conv", "part", F.max("top").over(Window.partitionBy("conv")).alias("top"), *[F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"x{k}") for k in (1, 2)])
    local = rows.select("*", *[F.bit_xor(f"h{k}").over(upto).alias(f"l{k}") for k in (1, 2)])
    d = [F.col(f"l{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)]
    return local.join(runs, ["conv", "part"]).select("conv", (F.col("pos") + 1).alias("depth"), d[0].alias("d1"), d[1].alias("d2"), d[0].bitwiseXOR(F.col("h1")).alias("p1"), d[1].bitwiseXOR(F.col("h2")).alias("p2"), "words", (F.col("pos") == F.col("top")).alias("last"))


def _cells(a: np.ndarray, b: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each row of the sketch."""
    a, b = a.view(U), b.view(U) | U(1)
    return np.stack([(words.mix(a + U(j) * b) % U(cells)).astype(np.int64) + j * cells for j in range(ROWS)])


def sketched(rows: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(cells, bits): for each cell of a count-min sketch of the digests (d1, d2) of n rows, whether it counts two or more."""
    cells = min(MAX_CELLS, max(SEGMENT, 1 << (4 * n).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(ROWS * cells, np.uint8)
        for batch in batches:
            at, c = np.unique(_cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cells), return_counts=True)
            have[at] = np.minimum(have[at] + np.minimum(c, 2), 2)
        for i in range(0, len(have), SEGMENT):
            part = have[i : i + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SEGMENT], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have = None, None
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.frombuffer(c, np.uint8)
                if s == at:
                    have = np.minimum(have + c, 2)
                else:
                    if have is not None:
                        yield _packed(at, have)
                    at, have = s, c
        if have is not None:
            yield _packed(at, have)

    def _packed(at: int, have: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(have > 1).tobytes()], pa.binary())], names=["segment", "counts"])

    kind = "segment int, counts binary"
    merged = rows.select("d1", "d2").mapInArrow(count, kind).repartition("segment").sortWithinPartitions("segment").mapInArrow(add, kind)
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for r in merged.collect():  # ROWS * MAX_CELLS / SEGMENT rows at most
        bits[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = np.frombuffer(r.counts, np.uint8)
    return cells, bits


def screened(rows: DataFrame, cells: int, bits: np.ndarray) -> DataFrame:
    """rows with `alone` (one conversation has the prefix, as its estimate proves) and `under` (the same of the prefix before it; never of the root)."""
    sent = rows.sparkSession.sparkContext.broadcast(bits.tobytes())
    schema = rows.withColumn("alone", F.lit(False)).withColumn("under", F.lit(False)).schema
    at = [rows.columns.index(c) for c in ("d1", "d2", "p1", "p2", "depth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(sent.value, np.uint8)

        def proven(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            c = _cells(a, b, cells)
            return ((have[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 0).any(axis=0)

        for batch in batches:
            d1, d2, p1, p2, depth = (batch.column(i).to_numpy() for i in at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(proven(d1, d2)), pa.array(proven(p1, p2) & (depth > 1))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends): SHA-256 of the numbers of the conversations that end at a node, in order; the list is read as a stream, not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for batch in batches:
            done = []
            a, b, c = (batch.column(i).to_pylist() for i in range(3))
            for k, conv in zip(zip(a, b), c):
                if k != at:
                    if at is not None:
                        done.append((*at, h.hexdigest()))
                    at, h = k, hashlib.sha256(b"%d" % conv)
                else:
                    h.update(b",%d" % conv)
            yield _rows(done)
        if at is not None:
            yield _rows([(*at, h.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["d1", "d2", "ends"])

    return ends.select("d1", "d2", "conv").repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv").mapInArrow(run, "d1 long, d2 long, ends string")


def _below(members: DataFrame, values: DataFrame) -> DataFrame:
    """(d1, d2, saved, leaves): for each node the sums of `values` (conv, depth, saved, leaf) at its depth and below, over its members."""
    none = F.lit(0).cast("long")
    both = members.select("conv", "depth", "d1", "d2", none.alias("saved"), none.alias("leaf")).unionByName(values.select("conv", "depth", F.lit(None).cast("long").alias("d1"), F.lit(None).cast("long").alias("d2"), "saved", "leaf"))
    both = both.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    later = Window.partitionBy("conv").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    sums = values.withColumn("stretch", F.floor(F.col("depth") / STRETCH)).groupBy("conv", "stretch").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("f"))
    # a stretch with a member and no value still needs what lies below it
    sums = sums.unionByName(members.select("conv", F.floor(F.col("depth") / STRETCH).alias("stretch")).distinct().select("conv", "stretch", none.alias("s"), none.alias("f")))
    sums = sums.groupBy("conv", "stretch").agg(F.sum("s").alias("s"), F.sum("f").alias("f"))
    sums = sums.select("conv", "stretch", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"), F.coalesce(F.sum("f").over(later), F.lit(0)).alias("f"))
    on = Window.partitionBy("conv", "stretch").orderBy(F.desc("depth"))
    mine = both.select("conv", "stretch", "d1", "d2", F.sum("saved").over(on).alias("saved"), F.sum("leaf").over(on).alias("leaf")).where("d1 is not null")
    total = mine.join(sums, ["conv", "stretch"], "left").select("d1", "d2", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaf") + F.coalesce("f", F.lit(0))).alias("leaf"))
    return total.groupBy("d1", "d2").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie of the conversations `convs` (conv) with the turns (conv, part, pos, t1, t2, words) that numbered() gives.

    (conv_id: the smallest member, depth, parent_conv_id: the parent's, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); the root
    has no parent. A conversation without turns ends at the root. Without conversations there is no node. Equal conversations with different numbers
    are members of the same nodes.
    """
    rows = written(prefixes(turns), "prefixes")
    cells, bits = sketched(rows, rows.count())
    known = written(screened(rows, cells, bits), "screened")
    members = written(convs.select("conv").distinct(), "conversations")
    ended = rows.where("last").select("conv", F.lit(True).alias("has"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "d1", "d2")]
    root = members.join(ended, "conv", "left").select("conv", *zero, F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), F.lit(0).cast("long").alias("words"), F.col("has").isNull().alias("last"))
    shared = known.where("not alone and not under").select(*root.columns).unionByName(root)
    heads, tails = known.where("alone and not under"), known.where("under")

    figures = [F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("conv", "depth", "words", "p1", "p2")]]
    nodes = written(shared.groupBy("d1", "d2").agg(*figures), "nodes")
    up = nodes.where("p1 is not null").select("p1", "p2").unionByName(heads.select("p1", "p2")).groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("children"))
    nodes = written(nodes.join(up.select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), "children"), ["d1", "d2"], "left").fillna(0, ["children"]), "nodes_with_children")
    ends = _hashed_ends(shared.where("last"))
    leaf = nodes.select("conv", "depth", ((F.col("n") - 1) * F.col("words")).alias("saved"), (F.col("children") == 0).cast("long").alias("leaf"))
    own = known.where("last and (alone or under)").select("conv", "depth", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf"))
    below = _below(shared, leaf.unionByName(own))
    parent = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent"))

    grouped = nodes.join(below, ["d1", "d2"], "left").join(ends, ["d1", "d2"], "left").join(parent, ["p1", "p2"], "left")
    grouped = grouped.select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("p1").isNotNull(), F.coalesce("parent", "conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                             F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"))

    def single(rows: DataFrame, above: Column) -> DataFrame:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        ends = F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_NOTHING))
        return rows.select(F.col("conv").alias("conv_id"), "depth", above.alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"))

    return grouped.unionByName(single(heads.join(parent, ["p1", "p2"], "left"), F.coalesce("parent", "conv"))).unionByName(single(tails, F.col("conv")))


#: The same tree by comparing whole paths, in plain SQL; CRC-32 bit by bit.
SQL = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 s AS (SELECT conv_id, count(*) AS n, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM t GROUP BY conv_id),
 c AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::bigint, steps), lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) % 4 AS h FROM s),
 m AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
 r AS (SELECT m.conv_id, t.pos - m.h + m.m AS pos, t.role, t.text FROM m JOIN t ON t.conv_id = m.conv_id AND t.pos >= m.h UNION ALL SELECT m.conv_id, t.pos, t.role, t.text FROM m JOIN t ON t.conv_id = m.base AND t.pos < m.m),
 p AS (SELECT conv_id, pos + 1 AS depth, string_agg(md5(md5(role) || md5(text)), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, pos = max(pos) OVER (PARTITION BY conv_id) AS last FROM r
   UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM r) FROM m),
 g AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, min(words) AS words, coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM p GROUP BY path, depth),
 k AS (SELECT left(path, 32 * (depth - 1)) AS up, count(*) AS children FROM g WHERE depth > 0 GROUP BY 1),
 f AS (SELECT g.*, coalesce(k.children, 0) AS children FROM g LEFT JOIN k ON k.up = g.path),
 b AS (SELECT a.path, count(*) FILTER (WHERE x.children = 0) AS leaves, sum((x.n - 1) * x.words) AS saved FROM f a JOIN f x ON starts_with(x.path, a.path) GROUP BY a.path)
 SELECT f.conv_id, f.depth::bigint AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.children AS n_children, b.leaves AS n_leaves, b.saved::bigint AS saved_tokens, sha256(f.ends) AS ends_sha256
 FROM f JOIN b USING (path) LEFT JOIN f u ON f.depth > 0 AND u.path = left(f.path, 32 * (f.depth - 1))"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt on the first turns of the one that leads its twenty."""
    turns = written(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), "numbered")
    return prefix_trie(*rebuilt(turns))
