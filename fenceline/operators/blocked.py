"""The best rows for each of a set of questions, found block by block, exactly.

Questions and rows are dealt into blocks by a hash of their id. One task holds one pair of blocks, so its memory is bounded however many
there are of either, and hands on the k best rows of each question only. Nothing is broadcast and nothing reaches the driver but two counts.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

QUESTION_BLOCK, ROW_BLOCK = 1024, 2048
DIGITS = 9


def block_counts(n_questions: int, n_rows: int) -> tuple[int, int]:
    return max(1, -(-n_questions // QUESTION_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))


def _best(qids: np.ndarray, dids: np.ndarray, scores: np.ndarray, seen: np.ndarray | None, k: int) -> list[pd.DataFrame]:
    """The k best of each line of `scores`; `dids` ascend, so that a stable sort leaves ties in order of id."""
    out = []
    for i, line in enumerate(np.round(scores, DIGITS)):
        at = np.arange(len(line)) if seen is None else np.flatnonzero(seen[i])
        if len(at) > k:
            least = np.partition(line[at], len(at) - k)[len(at) - k]
            at = at[line[at] >= least]
        at = at[np.argsort(-line[at], kind="stable")[:k]]
        out.append(pd.DataFrame({"query_id": np.repeat(qids[i : i + 1], len(at)), "doc_id": dids[at], "score": line[at]}))
    return out


def _by_block(questions: DataFrame, rows: DataFrame, chosen: Callable, scored: Callable, counts: tuple[int, int]) -> DataFrame:
    """(query_id, doc_id, score): what `chosen` keeps of the scores of each pair of blocks."""
    n_q, n_d = counts
    q = (questions.where("query_id is not null").withColumn("__q", F.pmod(F.xxhash64("query_id"), F.lit(n_q)))
         .withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1)))))
    d = (rows.where("doc_id is not null").withColumn("__d", F.pmod(F.xxhash64("doc_id"), F.lit(n_d)).cast("int"))
         .withColumn("__q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint")))))
    schema = T.StructType([T.StructField("query_id", questions.schema["query_id"].dataType), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def task(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [x for part in scored(a, b) for x in chosen(*part)] if len(a) and len(b) else []
        found = [x for x in found if len(x)]
        return pd.concat(found) if found else pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema})

    return q.groupBy("__d", "__q").cogroup(d.groupBy("__d", "__q")).applyInPandas(task, schema)


def top_k(questions: DataFrame, rows: DataFrame, scored: Callable[[pd.DataFrame, pd.DataFrame], Iterator], k: int, counts: tuple[int, int], out: str = "score") -> DataFrame:
    """(query_id, doc_id, `out`, rank): each question's k best rows, by score rounded to DIGITS places, ties to the smaller id.

    questions have query_id, rows doc_id, beside what `scored` reads; rows without an id take no part. scored(questions, rows) of one pair of
    blocks yields (query ids, ascending row ids, matrix of scores, matrix that is true where a pair counts, or None for all).
    """
    best = _by_block(questions, rows, lambda *part: _best(*part, k), scored, counts)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("score", out)


def above(questions: DataFrame, rows: DataFrame, scored: Callable[[pd.DataFrame, pd.DataFrame], Iterator], least: float, counts: tuple[int, int], out: str = "score") -> DataFrame:
    """(query_id, doc_id, `out`): every pair of a score greater than `least`; arguments as of top_k."""
    def chosen(qids: np.ndarray, dids: np.ndarray, scores: np.ndarray, seen: np.ndarray | None) -> list[pd.DataFrame]:
        i, j = np.nonzero(scores > least if seen is None else (scores > least) & seen)
        return [pd.DataFrame({"query_id": qids[i], "doc_id": dids[j], "score": scores[i, j]})]

    return _by_block(questions, rows, chosen, scored, counts).withColumnRenamed("score", out)


def products(q: pd.DataFrame, d: pd.DataFrame) -> Iterator:
    """Dot products of the column `v`, for each length of vector that both sides have."""
    d = d.sort_values("doc_id")
    width = {id(x): x["v"].map(len) for x in (q, d)}
    for n in sorted(set(width[id(q)]) & set(width[id(d)])):
        a, b = q[width[id(q)] == n], d[width[id(d)] == n]
        yield a["query_id"].to_numpy(), b["doc_id"].to_numpy(), np.stack(a["v"]) @ np.stack(b["v"]).T, None


def weighted_terms(q: pd.DataFrame, d: pd.DataFrame) -> Iterator:
    """Sums over shared terms of the question's count `qtf` times the row's weight `w`; pairs without a shared term do not count."""
    qids, qat = np.unique(q["query_id"].to_numpy(), return_inverse=True)
    dids, dat = np.unique(d["doc_id"].to_numpy(), return_inverse=True)
    codes, terms = pd.factorize(q["term"])
    wanted = terms.get_indexer(d["term"])
    order = np.argsort(wanted, kind="stable")
    ends = np.searchsorted(wanted[order], np.arange(len(terms) + 1))
    weight, count = d["w"].to_numpy(), q["qtf"].to_numpy()
    scores = np.zeros((len(qids), len(dids)))
    seen = np.zeros(scores.shape, dtype=bool)
    for i in range(len(q)):
        at = order[ends[codes[i]] : ends[codes[i] + 1]]
        scores[qat[i], dat[at]] += count[i] * weight[at]
        seen[qat[i], dat[at]] = True
    yield qids, dids, scores, seen
