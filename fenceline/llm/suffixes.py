"""Repeated windows of bytes across texts: the windows' order by most-significant-digit passes, stopped at the threshold.

Every suffix is looked at through its first `length` bytes only, its window. Two passes order the windows; after each, a group whose members
all lie in one text is done and goes no further:

1. The first digit is the window's anchor, the smallest hash among its MER-byte strings. Neighbouring windows share it, so a pass over all
   windows moves one key for about a dozen of them.
2. The second digit is the rest: all `length` bytes. The groups left are exactly the repeated windows, each with its smallest document.

A key goes to its bucket as the gap to the next smaller one of its chunk of texts, and the bucket answers with one bit for each key in the
order sent. A chunk sends a key once however often it holds it, so no key is hot. The texts are exchanged once; all passes read that
exchange. Copies of whole texts are told by their digests first and take no part in the passes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import words

LENGTH, MER = 50, 24
#: Bytes of whole texts in a chunk; one text at least.
CHUNK_BYTES = 4 << 20
#: Anchors go as their first bits: two that agree by chance are told apart by the next digit.
ANCHOR_BITS = 48
U = np.uint64
_PACKED = "chunk long, ids array<long>, cuts array<long>, data binary"


def packed(docs: DataFrame, key: Column, text: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Texts in chunks: keys, where each text begins and ends, and their bytes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, small = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            offsets, data = words.text_bytes(batch.column(1))
            for i, j in words.chunks(offsets, chunk_bytes):
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i))
                cuts = pa.array([(offsets[i : j + 1] - offsets[i]).tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, cuts, pa.array([small.compress(data[offsets[i] : offsets[j]].tobytes())], pa.binary())], names=["chunk", "ids", "cuts", "data"])
                number += 1

    return docs.select(key.cast("long").alias("__key"), text.alias("__text")).mapInArrow(run, _PACKED)


def _whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Chunk:
    """One packed row with the texts that take part; dull: places of the texts that do not."""

    def __init__(self, row: dict, dull: list[int], length: int):
        self.number, self.length, self.mer = row["chunk"], length, max(1, min(MER, length // 2))
        self.bytes = np.frombuffer(_whole(row["data"]), np.uint8)
        self.cuts = np.array(row["cuts"], np.int64)
        self.live = np.array([x is not None for x in row["ids"]], bool)
        self.live[dull] = False
        self.ids = np.array([0 if x is None else x for x in row["ids"]], np.int64)
        self.found: tuple | None = None

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, text, first, end) of every stretch of neighbouring windows of one text with one anchor; windows go by where they start."""
        parts = []
        for a, b in words.chunks(self.cuts):
            lo, hi = self.cuts[a], self.cuts[b]
            c = self.bytes[lo:hi]
            if len(c) < self.length:
                continue
            at = np.arange(len(c) - self.mer + 1)
            low, size, width = words.hashed(c, at, at + self.mer), 1, self.length - self.mer + 1
            while size * 2 <= width:
                low, size = np.minimum(low[:-size], low[size:]), size * 2
            if width > size:
                low = np.minimum(low[: size - width], low[width - size :])
            text = np.repeat(np.arange(a, b), np.diff(self.cuts[a : b + 1]))[: len(low)]
            whole = self.live[text] & (self.cuts[text + 1] - lo - np.arange(len(low)) >= self.length)
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(new)
            end = np.append(first[1:], len(low))
            keep = whole[first]
            parts.append((low[first][keep], text[first][keep], first[keep] + lo, end[keep] + lo))
        if not parts:
            return np.zeros(0, U), *[np.zeros(0, np.int64)] * 3
        return tuple(np.concatenate(x) for x in zip(*parts))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(distinct anchors in order, whether two texts of the chunk hold it, runs()); worked out once."""
        if self.found is None:
            runs = self.runs()
            runs = runs[0] >> U(64 - ANCHOR_BITS), *runs[1:]
            order = np.argsort(runs[0])
            k, t = runs[0][order], runs[1][order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
            twice = np.minimum.reduceat(t, first) != np.maximum.reduceat(t, first) if len(k) else np.zeros(0, bool)
            self.found = k[first], twice, runs
        return self.found

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows with a shared anchor: their starts and texts, each one's place among the distinct hashes; the anchors of these, and they in order."""
        keys, _, (anchor, text, first, end) = self.anchors()
        pick = np.flatnonzero(shared[np.searchsorted(keys, anchor)]) if len(keys) else np.zeros(0, np.int64)
        n = end[pick] - first[pick]
        start = np.arange(n.sum()) + np.repeat(first[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n)
        h = np.empty(len(start), U)
        for i in range(0, len(start), 1 << 18):  # hashes of a stretch of texts at a time
            s = start[i : i + (1 << 18)]
            lo = s[0]
            h[i : i + len(s)] = words.hashed(self.bytes[lo : s[-1] + self.length], s - lo, s - lo + self.length)
        order = np.argsort(h)
        hs = h[order]
        new = np.ones(len(order), bool)
        new[1:] = hs[1:] != hs[:-1]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return start, np.repeat(text[pick], n), place, np.repeat(anchor[pick], n)[order[new]], hs[new]


def _by_bucket(bucket: np.ndarray) -> np.ndarray:
    """Places by bucket, else as they are; small numbers are sorted by their digits."""
    return np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")


def _sent(chunk: Chunk, bucket: np.ndarray, key: np.ndarray, ids: np.ndarray | None) -> pa.RecordBatch:
    """A row for each bucket: its keys, which come in order, as gaps of as few bytes as the largest needs; ids as bytes beside them."""
    order = _by_bucket(bucket)
    b, k = bucket[order], key[order]
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    rows = []
    for i, j in zip(first, np.append(first[1:], len(b))):
        gaps = np.diff(k[i:j], prepend=U(0))
        width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
        own = b"" if ids is None else _indexed(ids[order[i:j]])
        rows.append((int(b[i]), chunk.number, width, gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), own))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], kinds[x]) for x in range(5)], names=["bucket", "chunk", "width", "gaps", "ids"])


def _indexed(ids: np.ndarray) -> bytes:
    """ids by their place in the list of the distinct ones."""
    own, at = np.unique(ids, return_inverse=True)
    return len(own).to_bytes(4, "little") + own.tobytes() + at.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes()


def _listed(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    own = np.frombuffer(b, np.int64, n, 4)
    return own[np.frombuffer(b, np.uint16 if n <= 1 << 16 else np.uint32, -1, 4 + 8 * n)]


def _keys(width: int, gaps: bytes) -> np.ndarray:
    raw = np.frombuffer(gaps, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view(U).ravel(), dtype=U)


def answered(sent: DataFrame, n: int) -> DataFrame:
    """(chunk, bucket, bits) for each row sent: without ids, whether another chunk sent the key; with ids, whether one sent it with a smaller id."""

    def bucket(rows: list[dict]) -> pa.RecordBatch:
        keys = [_keys(r["width"], r["gaps"]) for r in rows]
        cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        k = np.concatenate(keys)
        order = np.argsort(k)
        first = np.flatnonzero(np.append(True, k[order][1:] != k[order][:-1]))
        n = np.diff(np.append(first, len(k)))
        found = np.empty(len(k), bool)
        if rows[0]["ids"]:
            ids = np.concatenate([_listed(r["ids"]) for r in rows])
            found[order] = ids[order] > np.repeat(np.minimum.reduceat(ids[order], first), n)
        else:
            found[order] = np.repeat(n > 1, n)
        bits = [np.packbits(found[i:j]).tobytes() for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows]), pa.array([r["bucket"] for r in rows], pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "bucket", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    yield bucket(held)
                    held = []
                held.append(r)
        if held:
            yield bucket(held)

    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, bucket int, bits binary")


def _flags(answers: list[dict], bucket: np.ndarray) -> np.ndarray:
    """The answered bits, put to the keys they were asked for, which lie in these buckets."""
    order = _by_bucket(bucket)
    b, out = bucket[order], np.zeros(len(order), bool)
    for a in answers:
        i, j = np.searchsorted(b, [a["bucket"], a["bucket"] + 1])
        out[order[i:j]] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=j - i).astype(bool)
    return out


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, n_bytes, spans, kept) for each row: what earlier documents hold too, cut out of its text's UTF-8 bytes.

    A byte goes if a string of `length` bytes that covers it also starts in a row with a smaller key; all texts are judged as they came in.
    spans are the maximal runs removed (start, end: bytes), kept is the rest, as bytes. A null text is an empty one. Rows with equal
    keys do not count as earlier than each other. A row without a key is compared with nothing and stays whole. Strings are told apart by 64-bit
    hashes within a bucket dealt by another hash. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = packed(docs, F.col(key), F.col(text), chunk_bytes).repartition(n, "chunk")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cuts = row["cuts"]
                whole = [i for i in range(len(row["ids"])) if row["ids"][i] is not None and cuts[i + 1] - cuts[i] >= length]
                data = _whole(row["data"])
                d = [hashlib.blake2b(data[cuts[i] : cuts[i + 1]], digest_size=16).digest() for i in whole]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(whole), pa.int64()), pa.array(whole, pa.int32()), pa.array([row["ids"][i] for i in whole], pa.int64()), pa.array(d, pa.binary())], names=["chunk", "at", "id", "digest"])

    every = texts.mapInArrow(digests, "chunk long, at int, id long, digest binary")
    first = every.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "least")
    copies = every.join(first, "digest").where("id > least").groupBy("chunk").agg(F.sort_array(F.collect_list("at")).alias("copies"))

    def beside(*sides: DataFrame) -> DataFrame:
        out = texts
        for s in sides:
            out = out.join(s.hint("shuffle_hash"), "chunk", "left")
        return out

    def by_chunk(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    def dealt(k: np.ndarray) -> np.ndarray:
        return (words.mix(k) % U(n)).astype(np.int64)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row, row["copies"] or [], length)
                k = chunk.anchors()[0]
                yield _sent(chunk, dealt(k), k, None)

    def shared(chunk: Chunk, row: dict) -> np.ndarray:
        k, twice, _ = chunk.anchors()
        return twice | _flags(row["one"] or [], dealt(k))

    def least(chunk: Chunk, text_: np.ndarray, place: np.ndarray, n_keys: int) -> np.ndarray:
        ids = np.full(n_keys, np.iinfo(np.int64).max)
        np.minimum.at(ids, place, chunk.ids[text_])
        return ids

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row, row["copies"] or [], length)
                _, text_, place, a, h = chunk.windows(shared(chunk, row))
                yield _sent(chunk, dealt(a), h, least(chunk, text_, place, len(h)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row, row["copies"] or [], length)
                start, text_, place, a, h = chunk.windows(shared(chunk, row))
                gone = _flags(row["two"] or [], dealt(a))[place] | (chunk.ids[text_] > least(chunk, text_, place, len(h))[place])
                yield _result(chunk, row, start[gone])

    def _result(chunk: Chunk, row: dict, starts: np.ndarray) -> pa.RecordBatch:
        cover = np.zeros(len(chunk.bytes) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.subtract.at(cover, starts + length, 1)
        for i in row["copies"] or []:
            cover[chunk.cuts[i]] += 1
            cover[chunk.cuts[i + 1]] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.ones(len(gone) + 1, bool)
        edge[1:-1] = gone[1:] != gone[:-1]
        edge[chunk.cuts] = True
        at = np.flatnonzero(edge)
        run = gone[at[:-1]] if len(at) else np.zeros(0, bool)
        lo, hi = at[:-1][run], at[1:][run]
        owner = np.searchsorted(chunk.cuts, lo, "right") - 1
        counts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(chunk.ids)))]).astype(np.int32)
        base = chunk.cuts[owner]
        spans = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays([pa.array(lo - base), pa.array(hi - base)], names=["start", "end"]))
        rest = chunk.bytes[~gone]
        ends = np.concatenate([[0], np.cumsum(~gone)])[chunk.cuts]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunk.ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(rest.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(np.diff(chunk.cuts)), spans, kept], names=[key, "n_bytes", "spans", "kept"])

    sent = "bucket int, chunk long, width int, gaps binary, ids binary"
    one = by_chunk(answered(beside(copies).mapInArrow(ask_anchors, sent), n), "one")
    two = by_chunk(answered(beside(copies, one).mapInArrow(ask_windows, sent), n), "two")
    return beside(copies, one, two).mapInArrow(cut, f"`{key}` long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50-byte strings of earlier documents take out of every text."""
    got = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
