"""Packing into training sequences by lexical retrieval: a seed document's window is filled with its nearest unused neighbours by BM25.

The corpus is laid out by a MinHash of each document's token pairs and cut into shards of bounded size, so lexically close documents
share a shard. Each shard has its own inverted index over token ids, with document frequencies and lengths of the shard, as sharded
search engines do. A neighbour that does not fit is cut; its rest stays in the shard and seeds the next window. What is left open at a
shard's end moves on to the next one, and at a task's end falls into sequences of powers of two, so there is no padding.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import words
from .store import written

VOCABULARY = "byte_bpe_50k"
WINDOW = 2048
END_ID = 1
#: Tokens of a shard and of a task. QUERY_TERMS is the length of a query: a seed's rarest token ids in the shard.
SHARD_TOKENS = 2_000_000
TASK_TOKENS = 8_000_000
QUERY_TERMS = 32
K1, B = 1.2, 0.75
_loaded: dict = {}


def encoder(name: str = VOCABULARY):
    """(function, number of ids); the function gives a text's ids by tokenizers' file `name`.json, without added tokens, special strings handled as its default.

    The same vocabulary as ranks gives the same ids for ordinary text several times faster; texts that hold one of the vocabulary's
    special strings go to the tokenizer itself.
    """
    if name not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        whole.no_padding()
        whole.no_truncation()
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if any(s in text for s in special):
                return whole.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _loaded[name] = encode, max(whole.get_vocab_size(with_added_tokens=True), END_ID + 1)
    return _loaded[name]


def _layout_key(ids: np.ndarray) -> int:
    """MinHash of a document's pairs of ids."""
    pair = ids[:-1].astype(np.uint64) << np.uint64(20) | ids[1:].astype(np.uint64) if len(ids) > 1 else ids.astype(np.uint64)
    return int(words.mix(pair + np.uint64(0x9E3779B97F4A7C15)).min() >> np.uint64(1))


def encoded(docs: DataFrame, text: str, keep: tuple[str, ...], vocabulary: str) -> DataFrame:
    """The kept columns (as __0, __1, ...), __key (layout), __n (ids, END_ID included) and __ids (unsigned, little endian, 16-bit
    where the vocabulary allows it)."""
    src = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    own = [("__key", T.LongType()), ("__n", T.LongType()), ("__ids", T.BinaryType())]
    schema = T.StructType([*src.schema.fields[:-1], *[T.StructField(*f) for f in own]])

    def run(batches):
        encode, n = encoder(vocabulary)
        kind = "<u2" if n <= 1 << 16 else "<u4"
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [np.array([*encode(t.as_py() or ""), END_ID], kind) for t in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([_layout_key(x) for x in ids], pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                                                  pa.array([x.tobytes() for x in ids], pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


class Index:
    """BM25 over the token ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray]):
        size = np.array([len(d) for d in docs])
        pair = np.concatenate(docs).astype(np.int64)  # one 64-bit copy of the shard; all that is kept has 32 bits
        pair *= len(docs)
        pair += np.repeat(np.arange(len(docs)), size)
        pair.sort()
        at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        tf = np.diff(np.append(at, len(pair))).astype(np.float32)
        pair = pair[at]
        self.doc = (pair % len(docs)).astype(np.int32)
        term = (pair // len(docs)).astype(np.int32)
        del pair, at
        self.first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        self.terms, self.df = term[self.first], np.diff(np.append(self.first, len(term)))
        length = (K1 * (1 - B + B * size / size.mean())).astype(np.float32)
        self.weight = np.repeat(np.log1p((len(docs) - self.df + 0.5) / (self.df + 0.5)).astype(np.float32), self.df)
        self.weight *= tf * np.float32(K1 + 1) / (tf + length[self.doc])
        self.n = len(docs)

    def scores(self, ids: np.ndarray, terms: int) -> np.ndarray:
        t = np.searchsorted(self.terms, np.unique(ids))
        t = t[np.argsort(self.df[t], kind="stable")[:terms]]
        at = np.concatenate([np.arange(self.first[x], self.first[x] + self.df[x]) for x in t])
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


@dataclass
class Piece:
    row: int
    start: int
    length: int
    sequence: int
    offset: int


def pack_shard(docs: list[np.ndarray], starts: list[int], next_id: int, window: int = WINDOW, terms: int = QUERY_TERMS) -> tuple[list[Piece], int, list[Piece]]:
    """(pieces of full sequences, next sequence id, pieces of the open one) for documents of which ids before `starts` are placed already."""
    at = list(starts)
    size = [len(d) for d in docs]
    unused = np.ones(len(docs), bool)
    index = Index(docs) if len(docs) > 1 else None
    done: list[Piece] = []
    open_: list[Piece] = []
    room, seed, first, order = window, None, 0, []
    while True:
        if seed is None:  # a new window: the rest of a cut document, or the next in the layout
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return done, next_id, open_
            seed = first
        row = seed
        if open_:
            order = [j for j in order if unused[j]]
            if not order:
                left = np.flatnonzero(unused)
                if not len(left):
                    return done, next_id, open_
                score = ranked[left]
                few = np.argpartition(-score, 15)[:16] if len(left) > 16 else np.arange(len(left))
                order = [int(left[j]) for j in few[np.lexsort((left[few], -score[few]))]]
            row = order.pop(0)
        n = min(room, size[row] - at[row])
        if not open_ and n < window:
            ranked = index.scores(docs[row], terms) if index else np.zeros(1)
            order = []
        open_.append(Piece(row, at[row], n, next_id, window - room))
        at[row] += n
        room -= n
        if at[row] == size[row]:
            unused[row] = False
        if room == 0:
            done += open_
            next_id, room, open_ = next_id + 1, window, []
            seed = row if unused[row] else None


def powers_of_two(pieces: list[Piece], next_id: int) -> tuple[list[Piece], int]:
    """The pieces of an open sequence in sequences whose lengths are powers of two, longest first."""
    out: list[Piece] = []
    left = sum(p.length for p in pieces)
    queue = [(p.row, p.start, p.length) for p in pieces]
    while left:
        size = 1 << (left.bit_length() - 1)
        offset = 0
        while offset < size:
            row, start, n = queue.pop(0)
            take = min(n, size - offset)
            out.append(Piece(row, start, take, next_id, offset))
            if take < n:
                queue.insert(0, (row, start + take, n - take))
            offset += take
        next_id, left = next_id + 1, left - size
    return out, next_id


def pack(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS,
         task_tokens: int = TASK_TOKENS, terms: int = QUERY_TERMS) -> DataFrame:
    """One row per piece: the kept columns, start, length, doc_tokens, sequence_id, offset and ids (unsigned 32-bit, little endian).

    A document is its text's ids and END_ID; a null or empty text is END_ID alone. Every id lies in one piece. Sequences have `window`
    ids but for the last of a task, which are powers of two. Equal rows are packed each on its own; other columns are not read.
    """
    rows = written(encoded(docs, text, keep, vocabulary), "encoded")
    total = rows.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    names = [f"__{i}" for i in range(len(keep))]
    orderable = [n for n in names if not isinstance(rows.schema[n].dataType, T.MapType)]
    laid = rows.repartitionByRange(max(1, -(-total // task_tokens)), "__key", *orderable).sortWithinPartitions("__key", *orderable)
    own = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType())]
    schema = T.StructType([*rows.select(*names).schema.fields, *[T.StructField(*f) for f in own]])

    def run(batches):
        _loaded.clear()  # a worker that has encoded texts before needs no vocabulary here
        next_id = TaskContext.get().partitionId() << 32

        def table(pieces: list[Piece], kept: pa.Table, ids: list[np.ndarray]) -> list[pa.RecordBatch]:
            if not pieces:
                return []
            cols = [kept.column(i).take(pa.array([p.row for p in pieces])) for i in range(len(keep))]
            for values in zip(*[(p.start, p.length, len(ids[p.row]), p.sequence, p.offset) for p in pieces]):
                cols.append(pa.array(values, pa.int64()))
            cols.append(pa.array([ids[p.row][p.start : p.start + p.length].astype("<u4").tobytes() for p in pieces], pa.binary()))
            return pa.Table.from_arrays(cols, names=schema.names).combine_chunks().to_batches(max_chunksize=1000)

        kept: list[pa.RecordBatch] = []
        ids: list[np.ndarray] = []
        starts: list[int] = []

        def settle(next_id: int, last: bool):
            held = pa.Table.from_batches(kept).combine_chunks()
            done, next_id, rest = pack_shard(ids, starts, next_id, window, terms)
            if last:
                more, next_id = powers_of_two(rest, next_id)
                return table(done + more, held, ids), next_id
            out = table(done, held, ids)
            moved = [p.row for p in rest]
            carried = held.take(pa.array(moved, pa.int64())).combine_chunks().to_batches()
            kept[:], ids[:], starts[:] = carried, [ids[r] for r in moved], [p.start for p in rest]
            return out, next_id

        size = 0
        for batch in batches:
            own, begin = pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(c)]) for c in range(len(names))], names=names), 0
            for i, (n, x) in enumerate(zip(batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2))):
                raw = x.as_py()
                ids.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"))
                starts.append(0)
                size += n
                if size >= shard_tokens:
                    kept.append(own.slice(begin, i + 1 - begin))
                    out, next_id = settle(next_id, False)
                    size, begin = 0, i + 1
                    yield from out
            if begin < own.num_rows:
                kept.append(own.slice(begin))
        if ids:
            yield from settle(next_id, True)[0]

    got = laid.mapInArrow(run, schema)
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *[f[0] for f in own])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048."""
    got = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
