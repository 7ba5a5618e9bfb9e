"""Quality by compression bands: text that compresses far better or far worse than prose of its length is no prose.

The zstandard ratio (compressed / raw bytes) falls with length, so each power of two of the length has its own band. The whole text
and its fixed chunks are both held against the bands: the first finds repetition across a text, the second a bad stretch within it.
"""
from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import plain

#: floor(log2(bytes)) -> (least, most) ratio of ordinary prose at level 3. Shorter texts say too little and are not judged.
BANDS = {
    6: (0.70, 1.20),
    7: (0.52, 1.05),
    8: (0.52, 0.90),
    9: (0.495, 0.82),
    10: (0.46, 0.72),
    11: (0.445, 0.68),
    12: (0.42, 0.66),
    13: (0.408, 0.66),
    14: (0.396, 0.66),
    15: (0.37, 0.66),
}
LONGEST_BAND = (0.35, 0.66)
CHUNK_BYTES = 4096
MAX_BAD_CHUNKS = 0.3
SYMBOLS = b"#*$%&|<>"


def band(n_bytes: int, bands: dict = BANDS, longest: tuple = LONGEST_BAND) -> tuple[float, float] | None:
    k = n_bytes.bit_length() - 1
    return bands.get(k) or (longest if bands and k > max(bands) else None)


def base_counts(b: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text in UTF-8."""
    words = b.split()
    n = len(words)
    chars = len(b"".join(words).decode())
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    if b"\n" in b:
        for line in b.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip(b" \t\n\r\x0b\x0c"):
                seen.add(line)
    repeat = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        times = Counter(windows)
        if len(times) < len(windows):
            covered = 0  # words before this position are counted already
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeat += i + 5 - max(i, covered)
                    covered = i + 5
    return n, chars, symbols, dup, repeat


def ratios(b: bytes, coder, chunk_bytes: int = CHUNK_BYTES) -> tuple[float | None, bool, float]:
    """(ratio of the whole text, whether it lies outside its band, share of the chunks' bytes outside theirs)."""
    if not b:
        return None, False, 0.0

    def out(x: bytes) -> tuple[float, bool]:
        r = len(coder.compress(x)) / len(x)
        limits = band(len(x))
        return r, limits is not None and not limits[0] <= r <= limits[1]

    whole, bad = out(b)
    if len(b) <= chunk_bytes:
        return whole, bad, float(bad)
    edges = list(range(0, len(b) - chunk_bytes // 2, chunk_bytes)) + [len(b)]
    wrong = sum(y - x for x, y in zip(edges, edges[1:]) if out(b[x:y])[1])
    return whole, bad, wrong / len(b)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def assess(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), level: int = 3, max_bad_chunks: float = MAX_BAD_CHUNKS) -> DataFrame:
    """One row per row of docs: the kept columns, base counts, base_failed, kept, the whole text's ratio and the share of bad chunks.

    kept is false if the base rules fail, if the whole text's ratio lies outside the band of its length, or if over `max_bad_chunks` of
    its bytes lie in chunks outside theirs. A null or empty text has no words, so it fails the base rules; its ratio is null. Texts of
    any length are read whole; repeated rows are judged alike; other columns are not read.
    """
    schema = docs.select(*keep).schema
    for part in SCHEMA.split(", "):
        schema = schema.add(*part.split())

    def run(batches):
        import zstandard

        coder = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            rows = []
            for t in batch.column(len(keep)):
                b = (t.as_py() or "").encode()
                counts = base_counts(b)
                ratio, bad, chunks = ratios(b, coder)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                rows.append((*counts, failed, not (failed or bad or chunks > max_bad_chunks), ratio, chunks))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64()]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that assess() keeps, with all their columns under their own names, whatever these are."""
    rows, names = plain(docs)
    return assess(rows, names[text], tuple(rows.columns)).where("kept").select(*rows.columns).toDF(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the compression bands for every document."""
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
