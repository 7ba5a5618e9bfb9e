"""Language identification by compression: the language whose sample text helps most to encode a text.

Each language has a raw-content zstandard dictionary made of labelled texts. A whole text is encoded with every dictionary, in lower case on both sides; the
smallest result names the language. A narrow margin between the two smallest is reported as rejected.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")

#: Bounds of what is fitted: labelled texts looked at for a language, and bytes of its dictionary.
SAMPLE_TEXTS = 200
DICTIONARY_BYTES = 64 * 1024
PIECE_CHARS = 1024


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries from labelled rows: language -> raw content.

    The fit uses a bounded sample: about `sample_texts` distinct texts of each language, all of them if there are no more, chosen by a hash of the text, of each at most
    PIECE_CHARS characters from a place that the hash also chooses, and in all at most `dictionary_bytes`. Rows with a null text or
    label, or without a letter, teach nothing. An empty table gives no languages.
    """
    known = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    h = F.xxhash64("t", F.lit(17))
    counts = {r["l"]: r["n"] for r in known.select("l", h.alias("h")).distinct().groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * sample_texts / n))]), F.col("l"))
    at = F.pmod(F.col("h"), F.greatest(F.char_length("t") - F.lit(PIECE_CHARS) + 1, F.lit(1))).cast("int") + 1
    rows = (known.withColumn("h", h).where(F.pmod(F.col("h"), F.lit(1 << 30)) < share * float(1 << 30)).dropDuplicates(["l", "h"])
            .select("l", "h", F.substr(F.col("t"), at, F.lit(PIECE_CHARS)).alias("p")).collect())
    out = {}
    for name in sorted(counts):
        picked, size = [], 0
        for r in sorted((r for r in rows if r["l"] == name and LETTER.search(r["p"])), key=lambda r: (r["h"], r["p"])):
            b = r["p"].lower().encode()
            if size + len(b) > dictionary_bytes:
                b = b[: dictionary_bytes - size]
            picked.append(b)
            size += len(b)
            if size >= dictionary_bytes:
                break
        if size >= 8:
            out[name] = b"\n".join(picked)
    return out


def _coders(dictionaries: dict[str, bytes], level: int):
    import zstandard

    out = []
    for name in sorted(dictionaries):
        d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((name, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)))
    return out


def predict(text: str | None, coders: list, sharpness: float = 24.0) -> tuple[str, float, float]:
    """(language, score, margin) of one text. Ties go to the first name in order."""
    if not text or not coders or not LETTER.search(text):
        return UNDETERMINED, 0.0, 0.0
    b = text.lower().encode()
    sizes = sorted((len(c.compress(b)), name) for name, c in coders)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    (first, name), (second, _) = sizes[:2]
    return name, 1.0 / (1.0 + (first / second) ** sharpness), 1.0 - first / second


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",), level: int = 6,
             min_margin: float = 0.01) -> DataFrame:
    """One row per row of docs: the kept columns, lang_pred, score, margin and rejected.

    A text that is null, empty or without a letter, or a call without dictionaries, gives `und`, 0, 0 and rejected. Texts of any length
    are encoded whole. Ties go to the first language by name; repeated rows are rows of their own; other columns are not read.
    """
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")

    def run(batches):
        coders = _coders(dictionaries, level)
        for batch in batches:
            got = [predict(t.as_py(), coders) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                                              pa.array([g[2] for g in got], pa.float64()), pa.array([g[2] < min_margin for g in got], pa.bool_())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    taught = docs.where(~held & F.col("doc_id").isNotNull())
    return identify(docs, learn(taught)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")
