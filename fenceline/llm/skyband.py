"""How far the sources of a language lie apart, and by which terms: a dominance skyband finds the terms, sparse sums the distances.

A term's value rises with its count in the group and falls with its count in the language. So a term that k others dominate, with no lower group
count, no higher language count and an earlier place in UTF-8 order, cannot be among the first k. Each partition keeps the terms of a group that fewer
than k of its own dominate; partitions' skybands are merged the same way in salted parts, and only what is left is valued and ranked.

Distances of two sources sum over all terms of the language. Terms that neither has are counted, terms that one has are summed by their
count, and only terms that both have are looked at one by one, term by term; a task keeps one sum per pair of sources.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import words
from .blocks import gather
from .store import written

#: Ranks of terms that are kept; documents of a language that a term must be in.
TOP, LEAST_DOCS = 200, 3
SCALE = 1_000_000_000
#: Parts into which the merge of a group's skybands is split.
SALTS = 16
CHUNK_BYTES = 4 << 20
U = np.uint64
_TERM = np.zeros(256, bool)
_TERM[0x80:] = _TERM[ord("A") : ord("Z") + 1] = _TERM[ord("a") : ord("z") + 1] = True


def term_spans(c: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the runs of ASCII letters and non-ASCII bytes in bytes that hold texts one after another."""
    inside = np.zeros(len(c) + 1, bool)
    inside[:-1] = _TERM[c]
    cut = np.zeros(len(c) + 1, bool)
    cut[doc_starts] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(doc_starts, starts, "right") - 1


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n: occurrences, d: documents) over docs (lang, source, text without nulls), summed over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = words.text_bytes(batch.column(2))
            pair = pa.table([batch.column(0), batch.column(1)], names=["lang", "source"])
            named = pair.group_by(["lang", "source"]).aggregate([])
            places = pc.index_in(pc.binary_join_element_wise(pc.binary_length(pair["lang"]).cast(pa.string()), pair["lang"], pair["source"], "\0"),
                                 value_set=pc.binary_join_element_wise(pc.binary_length(named["lang"]).cast(pa.string()), named["lang"], named["source"], "\0"))
            group = places.to_numpy().astype(np.int64)
            for i, j in words.chunks(offsets, CHUNK_BYTES):
                c = words.LOWER[data[offsets[i] : offsets[j]]]
                s, e, row = term_spans(c, offsets[i:j] - offsets[i])
                if not len(s):
                    continue
                g = group[i + row]
                k = words.mix(words.hashed(c, s, e) + g.astype(U) * U(0x9E3779B97F4A7C15))
                order = np.argsort(k, kind="stable")
                k, r = k[order], row[order]
                new = np.append(True, k[1:] != k[:-1])
                first = np.flatnonzero(new)
                fresh = new.copy()
                fresh[1:] |= r[1:] != r[:-1]
                top = order[first]
                cuts, text = gather(c, s[top], e[top])
                term = pa.LargeStringArray.from_buffers(len(top), pa.py_buffer(cuts), pa.py_buffer(text)).cast(pa.string())
                own = pa.array(g[top])
                yield pa.RecordBatch.from_arrays([named["lang"].combine_chunks().take(own), named["source"].combine_chunks().take(own), term, pa.array(np.diff(np.append(first, len(k)))),
                                                  pa.array(np.add.reduceat(fresh.astype(np.int64), first))], names=["lang", "source", "term", "n", "d"])

    rows = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def skyband(n: np.ndarray, total: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places that fewer than k others dominate: n no lower, total no higher, rank lower."""
    order = np.lexsort((rank, total, -n))
    t, r = total[order], rank[order]
    have_t, have_r, kept = np.zeros(0, t.dtype), np.zeros(0, r.dtype), []
    for i in range(0, len(order), 512):  # a dominator comes earlier in this order
        bt, br = t[i : i + 512], r[i : i + 512]
        by = ((have_t[None, :] <= bt[:, None]) & (have_r[None, :] < br[:, None])).sum(axis=1)
        by += np.tril((bt[None, :] <= bt[:, None]) & (br[None, :] < br[:, None]), -1).sum(axis=1)
        ok = by < k
        have_t, have_r = np.concatenate([have_t, bt[ok]]), np.concatenate([have_r, br[ok]])
        kept.append(i + np.flatnonzero(ok))
    return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)


def _banded(rows: DataFrame, k: int) -> DataFrame:
    """The skyband of each group (gid) of a partition whose rows come group by group; a group is read in batches and only its band is held."""

    def band(t: pa.Table) -> pa.Table:
        rank = np.empty(t.num_rows, np.int64)
        rank[pc.sort_indices(t["term"].cast(pa.binary())).to_numpy()] = np.arange(t.num_rows)
        return t.take(pa.array(np.sort(skyband(t["n"].to_numpy(), t["total"].to_numpy(), rank, k)))).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            g = t["gid"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            done = [band(t.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:])]
            held = done.pop()
            for x in done:
                yield from x.to_batches()
        if held is not None:
            yield from held.to_batches()

    return rows.sortWithinPartitions("gid").mapInArrow(run, rows.schema)


def _both(rows: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(a, b, more): what terms that both groups have add to the sum that takes each as held by one of them alone. rows: lang, term, gid, p, p0."""

    def add(sums: dict, gid: np.ndarray, p: np.ndarray, p0: np.ndarray, cuts: np.ndarray) -> None:
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        first = np.repeat(cuts[:-1], np.diff(cuts))
        own, at = np.unique(gid, return_inverse=True)
        total = np.zeros(len(own) ** 2, np.int64)
        upto, i = np.cumsum(size), 0
        while i < len(gid):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + limit, "right")))
            a = np.repeat(np.arange(i, j), size[i:j])
            b = np.arange(len(a)) - np.repeat(np.cumsum(size[i:j]) - size[i:j], size[i:j]) + first[a]
            a, b = a[a != b], b[a != b]
            value = _apart(p[a], p[b]) - _apart(p[a], p0[b]) - _apart(p0[a], p[b]) + _apart(p0[a], p0[b])
            np.add.at(total, at[a] * len(own) + at[b], value)
            i = j
        for x in np.flatnonzero(total):
            key = (int(own[x // len(own)]), int(own[x % len(own)]))
            sums[key] = sums.get(key, 0) + int(total[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            lang, term = t["lang"].combine_chunks(), t["term"].combine_chunks()
            same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.equal(term.slice(1), term.slice(0, len(term) - 1))).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(~same) + 1])
            add(sums, *(t[c].to_numpy()[: cuts[-1]] for c in ("gid", "p", "p0")), cuts)
            held = t.slice(cuts[-1])
            if len(sums) > 1 << 20:
                yield _summed(sums)
                sums = {}
        if held is not None:
            add(sums, *(held[c].to_numpy() for c in ("gid", "p", "p0")), np.array([0, held.num_rows]))
        yield _summed(sums)

    def _summed(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["a", "b", "more"])

    parts = rows.select("lang", "term", "gid", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return parts.mapInArrow(run, "a long, b long, more long").groupBy("a", "b").agg(F.sum("more").alias("more"))


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _share(n: str, all_: str, kinds: str) -> str:
    """SQL of a term's share in parts of a thousand millions, whole numbers throughout."""
    return f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({all_} + {kinds} as decimal(20,0))"


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of docs.

    `pair`: the other sources of the language by their distance, farthest first. `term`: the terms that the source has and uses more than the language
    as a whole, `top` of them. Ties go by UTF-8. A null in any of the three columns is an empty string; equal rows count as often as they
    come. A language without kept terms has distances of 0 and no terms. Other columns are not read. Languages and sources are told apart by their bytes.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = written(counted(plain), "counts")
    totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).drop("d")
    kept = written(counts.drop("d").join(totals, ["lang", "term"]), "kept")
    langs = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("total").alias("all"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("here"))
    groups = plain.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["here", "kinds", "all"])
    groups = written(groups.withColumn("gid", F.monotonically_increasing_id()).withColumn("p0", F.expr(f"if(kinds > 0, {_share('0', 'here', 'if(kinds > 0, kinds, 1)')}, 1)")), "groups")
    rows = kept.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "here", "kinds")))

    f = "(({p} - {q}) * ({p} - {q})) div {q}"
    one, two = (groups.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "gid", "p0")], *(["kinds"] if x == "a" else [])) for x in "ab")
    pairs = one.join(two, "lang").where("gid_a <> gid_b")
    times = rows.groupBy("lang", "gid", "p", "p0").agg(F.count(F.lit(1)).alias("c"))
    held = times.select("lang", F.col("gid").alias("g"), "p", F.col("p0").alias("z"), "c").join(groups.select("lang", F.col("gid").alias("o"), F.col("p0").alias("y")), "lang").where("g <> o")
    # a group's own terms, as if the other had none of them: once in the place of p, once in the place of q
    alone = held.select(F.col("g").alias("a"), F.col("o").alias("b"), F.expr(f"c * ({f.format(p='p', q='y')} - {f.format(p='z', q='y')})").alias("more")).unionByName(
        held.select(F.col("o").alias("a"), F.col("g").alias("b"), F.expr(f"c * ({f.format(p='y', q='p')} - {f.format(p='y', q='z')})").alias("more")))
    more = alone.unionByName(_both(rows)).groupBy("a", "b").agg(F.sum("more").alias("more"))
    value = F.expr(f"kinds * ({f.format(p='p0_a', q='p0_b')})") + F.coalesce("more", F.lit(0))
    far = pairs.join(more, (F.col("a") == F.col("gid_a")) & (F.col("b") == F.col("gid_b")), "left").select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), value.alias("value"))

    first = _banded(rows.select("gid", "term", "n", "total"), top)
    salted = first.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS))).repartition("gid", "salt").drop("salt")
    best = _banded(salted, top).join(groups, "gid").select("lang", "source", F.col("term").alias("item"), F.expr(_share("n", "here", "kinds")).alias("p"), F.expr(_share("total", "all", "kinds")).alias("q"))
    best = best.where("p > q").select("lang", "source", "item", F.expr(f.format(p="p", q="q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    parts = [far.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")), term.withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


#: The same by all terms of all pairs, in plain SQL.
SQL = """WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
 c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
 v AS (SELECT lang, count(*) AS kinds, sum(total) AS everything FROM k GROUP BY lang), s AS (SELECT lang, source, sum(n) AS here FROM c GROUP BY lang, source),
 g AS (SELECT x.lang, x.source, coalesce(v.kinds, 0) AS kinds, coalesce(v.everything, 0) AS everything, coalesce(s.here, 0) AS here FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang) LEFT JOIN s USING (lang, source)),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.here + g.kinds) AS p, 1 + 1000000000::hugeint * (k.total + 1) // (g.everything + g.kinds) AS q
   FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::bigint AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
   UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint FROM p WHERE n > 0 AND p > q)
 SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM o) WHERE part = 'pair' OR rank <= 200"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of sources and the terms that tell a source from its language, over all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))
