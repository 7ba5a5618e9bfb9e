"""Postings of tokens by block: each distinct token of a block of documents once, with the documents that hold it.

A block is a run of whole texts of about BLOCK_BYTES (one text at least), so a token that every document holds is still many small
rows, and what is joined or shuffled by token is the distinct tokens of blocks instead of every (document, token) pair.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import words

BLOCK_BYTES = 16 << 20
BLOCK_DOCS = 1 << 16
#: One row per distinct token of a block, and one row per block with a null token for its documents. A cell holds a document's place in
#: the block (16 bits), its mark (1 bit) and how often the token is in it (14 bits; more often takes more cells).
SCHEMA = "token string, block long, cells array<int>"
MOST = (1 << 14) - 1


def gather(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the byte ranges one after another."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return offsets, c[at]


def _pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row), by hash, with times; as (first position, row, times)."""
    order = np.lexsort((row, h))
    hs, rs = h[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    first = np.flatnonzero(new)
    return order[first], rs[first], np.diff(np.append(first, len(order)))


def distinct_tokens(parts: list) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, list offsets, rows and times of the chunks of one block together."""
    h, row, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    first = np.flatnonzero(new)
    base = np.cumsum([0] + [len(p[0]) for p in parts])
    lo, data = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
    shift = np.concatenate([np.full(len(p[0]), s) for p, s in zip(parts, np.cumsum([0] + [len(p[4]) for p in parts]))])
    hi = np.concatenate([p[5] for p in parts])
    at = order[first]
    offsets, text = gather(data, lo[at] + shift[at], hi[at] + shift[at])
    assert base[-1] == len(h)
    tokens = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(text)).cast(pa.string())
    return tokens, np.append(first, len(hs)).astype(np.int32), row[order], n[order]


def postings(docs: DataFrame, text: Column, info: list[Column], spans: Callable | None = None, lower: bool = False, block_bytes: int = BLOCK_BYTES,
             mark: Column | None = None, end: str | None = None) -> DataFrame:
    """Postings of the tokens of whole texts. A block's row with a null token lists its documents in `cells`, with `info` of each.

    spans(bytes, text starts) gives each token's start, end and text (default: words of other than ASCII white space). Blocks are numbered
    by task, so they are good for one written table only. `mark` is a flag of the document that its cells carry. `end` is a token that
    every text, an empty one too, holds once besides its own.
    """
    find = spans or words.word_spans
    src = docs.select(text.alias("__text"), F.struct(*info).alias("__info"), F.coalesce(mark if mark is not None else F.lit(False), F.lit(False)).alias("__mark"))
    kind = src.schema["__info"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            offsets, data = words.text_bytes(batch.column(0))
            marks = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32) << 14
            ranges = [(a, min(a + BLOCK_DOCS, j)) for i, j in words.chunks(offsets, block_bytes) for a in range(i, j, BLOCK_DOCS)]
            for i, j in ranges:
                number += 1
                ids = (np.arange(j - i, dtype=np.int32) << 15) | marks[i:j]
                parts = []
                for k, m in words.chunks(offsets[i : j + 1]):
                    k, m = k + i, m + i
                    c = data[offsets[k] : offsets[m]]
                    c = words.LOWER[c] if lower else c
                    s, e, row = find(c, offsets[k:m] - offsets[k])
                    if len(s):
                        first, r, n = _pairs(row, h := words.hashed(c, s, e))
                        lo, text_ = gather(c, s[first], e[first])
                        parts.append((h[first], ids[k - i + r], n, lo[:-1], text_, lo[1:]))
                details = batch.column(1).slice(i, j - i)
                yield _batch(pa.nulls(1, pa.string()), number, np.array([0, j - i]), ids, details, details.type)
                if end is not None:
                    yield _batch(pa.array([end]), number, np.array([0, j - i]), ids | 1, None, details.type)
                if parts:
                    tokens, cuts, rows, n = distinct_tokens(parts)
                    for a in range(0, len(tokens), 50_000):
                        b = min(a + 50_000, len(tokens))
                        lo, hi = cuts[a], cuts[b]
                        cells, own = _cells(rows[lo:hi], n[lo:hi], cuts[a : b + 1] - lo)
                        yield _batch(tokens.slice(a, b - a), number, own, cells, None, details.type)

    def _cells(rows, n, cuts):
        if n.max() <= MOST:
            return rows | n.astype(np.int32), cuts
        more = (n - 1) // MOST + 1  # cells for each
        at = np.concatenate([[0], np.cumsum(more)])
        last = np.zeros(at[-1], bool)
        last[at[1:] - 1] = True
        return np.repeat(rows, more) | np.where(last, np.repeat(n - (more - 1) * MOST, more), MOST).astype(np.int32), at[cuts]

    def _batch(tokens, number, cuts, cells, details, kind):
        lists = pa.array(np.asarray(cuts, np.int32))
        infos = pa.ListArray.from_arrays(lists, details) if details is not None else pa.nulls(len(tokens), pa.list_(kind))
        return pa.RecordBatch.from_arrays([tokens, pa.array(np.full(len(tokens), number)), pa.ListArray.from_arrays(lists, pa.array(cells)), infos], names=["token", "block", "cells", "info"])

    return src.mapInArrow(run, f"{SCHEMA}, info array<{kind}>")


def taught() -> Column:
    """How often a posting's token is in marked documents."""
    return F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(x.bitwiseAND(1 << 14) != 0, x.bitwiseAND(MOST)).otherwise(0))


def by_document(joined: DataFrame, info: list[str], **sums: str) -> DataFrame:
    """One row per document of the postings: its info columns, and for each name the sum of times * (column of the token)."""
    none = F.array().cast(joined.schema["info"].dataType)  # arrays_zip fills the shorter array with nulls
    cells = F.explode(F.arrays_zip("cells", F.coalesce("info", none).alias("info"))).alias("x")
    times = F.col("x.cells").bitwiseAND(MOST)
    flat = joined.select("block", *[F.col(c).alias(f"__{k}") for k, c in sums.items()], cells).select(
        "block", F.shiftright("x.cells", 15).alias("__row"), *[F.col(f"x.info.{c}").alias(c) for c in info], *[(times * F.col(f"__{k}")).alias(f"__{k}") for k in sums])
    return flat.groupBy("block", "__row").agg(*[F.max(c).alias(c) for c in info], *[F.coalesce(F.sum(f"__{k}"), F.lit(0)).alias(k) for k in sums]).drop("block", "__row")
