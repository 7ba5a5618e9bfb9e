"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies.

In the vocabulary used here no piece continues past a space that follows another character, so a text falls into pre-tokens that begin
at each run of spaces and are merged on their own. Distinct pre-tokens are those of a block of whole texts, and the join of their counts
to the frequencies (document, pre-token, times) stays within the block, so nothing is shuffled.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words
from .blocks import gather

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BLOCK_BYTES = 4 << 20
_loaded: dict = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def processor(path: str):
    """The tokenizer of a file, loaded once per worker."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def pre_tokens(c: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each run of spaces with what follows it. Every text begins with a space."""
    if not len(c):
        z = np.zeros(0, np.int64)
        return z, z, z
    blank = c == 32
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    begin[doc_starts[doc_starts < len(c)]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], len(c)), np.searchsorted(doc_starts, starts, "right") - 1


def count_pieces(tokens: list[str], path: str) -> list[int]:
    """Pieces of each pre-token. The tokenizer puts a space of its own before a text, so the first one is left out."""
    got = processor(path).encode([t[1:] for t in tokens], num_threads=1)
    return [len(ids) if t != " " else 1 for t, ids in zip(tokens, got)]


def block_counts(c: np.ndarray, doc_starts: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text of a block."""
    if not len(c):
        return np.zeros(len(doc_starts), np.int64)
    starts, ends, row = pre_tokens(c, doc_starts)
    _, first, which = np.unique(words.hashed(c, starts, ends), return_index=True, return_inverse=True)
    offsets, text = gather(c, starts[first], ends[first])
    distinct = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(text)).to_pylist()
    pieces = np.array(count_pieces(distinct, path), np.int64)
    pair, times = np.unique(row * len(first) + which, return_counts=True)  # (document, pre-token) and how often
    return np.bincount(pair // len(first), times * pieces[pair % len(first)], minlength=len(doc_starts)).astype(np.int64)


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Texts are counted whole at any length. Null keys and repeated rows are rows of
    their own; an empty table gives an empty one; other columns are not read.
    """
    path = path or model_path()
    t = F.col(text)
    spaced = F.when(F.length(t) > 0, F.concat(F.lit(" "), F.replace(t, F.lit("▁"), F.lit(" "))))
    src = docs.select(key, F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"), spaced.alias("__text"))
    schema = src.select(key, "n_bytes").schema.add("n_tokens", "long")

    def run(batches):
        for batch in batches:
            offsets, data = words.text_bytes(batch.column(2))
            sums = [block_counts(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], path) for i, j in words.chunks(offsets, block_bytes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *sums]))], names=schema.names)

    return src.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and whether a document is over 4096 tokens, for every whole text."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
