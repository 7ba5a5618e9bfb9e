"""Secret scans: fixed forms, and strings that look drawn at random.

Two first-order Markov models of characters, one of random strings and one of ordinary identifiers, are trained from labelled samples.
A long run of token characters whose log-likelihood ratio favours the random model is a secret; of other runs the long stretches that do.
Where fixed forms cover a run in part, what they leave of it is looked at in the same way. All of it is column expressions: a
pattern's matches have their places from the lengths of what lies between them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import plain

#: Fixed forms: kind -> (pattern, group that is measured, least length of it). Leftmost matches that do not overlap.
FORMS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
KINDS = [*FORMS, "random"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
PIECE = r"[A-Za-z0-9+=]{20,}"
MIN_CHARS = 20
IDENTIFIER = r"[A-Za-z0-9_-]{6,}"
#: Log-likelihood ratio (natural) that a candidate has to exceed, and its least mean per pair of characters.
MIN_RATIO = 14.0
MIN_MEAN = 0.35
#: Bounds of the fit: documents looked at for identifiers, and random strings drawn.
SAMPLE_DOCS = 2000
SAMPLE_RANDOM = 4000
REDACTED = "<secret>"
SPAN = "array<struct<start: int, kind: int, end: int>>"


#: Cells that are folded into one short array before the arrays are joined, and characters of a piece of a text.
CHUNK = 256
TEXT_CHUNK = 4096


def scan(cells: Column, zero: Column, step, kind: str) -> Column:
    """What `step` puts out over an array, in order: step(state, cell) gives the next state and a value of type `kind`, or null for none.

    Linear in the array: values are gathered in short arrays of CHUNK cells at most.
    """
    none, gathered = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    starts = lambda whole: F.sequence(F.lit(0), F.floor(F.size(whole) / CHUNK).cast("int"))

    def one(acc: Column, x: Column) -> Column:
        state, value = step(acc["state"], x)
        return F.struct(state.alias("state"), F.when(value.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(value))).alias("out"))

    def chunk(whole: Column, acc: Column, i: Column) -> Column:
        return F.aggregate(F.slice(whole, i * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["state"].alias("state"), none.alias("out")), one,
                           lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    # a variable of a lambda is worked out once; the array itself would be for every chunk
    over = lambda whole: F.flatten(F.aggregate(starts(whole), F.struct(zero.alias("state"), gathered.alias("out")), lambda acc, i: chunk(whole, acc, i))["out"])
    return F.get(F.transform(F.array(cells), over), F.lit(0))


def found_cells(text: Column, pattern: str, group: int = 0) -> Column:
    """Cells (g, m, v, c) of a pattern: characters before each match, its own, those of its group, and the match; a last one for what follows."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = lambda x: F.transform(x, F.char_length)
    return F.when(text.rlike(pattern), F.arrays_zip(lengths(between).alias("g"), lengths(found).alias("m"), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("v"), found.alias("c")))


def matches(cells: Column, kind: int, least: int = 0, text: bool = False) -> Column:
    """Spans (start, kind, end) in code points of the matches in found_cells whose group has `least` characters; with `text`, the match as `c`."""
    def step(at: Column, x: Column):
        start = at + x["g"]
        end = start + F.coalesce(x["m"], F.lit(0))
        span = [start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")] + [x["c"].alias("c")] * text
        return end, F.when(x["v"] >= least, F.struct(*span))

    extra = ", c: string" * text
    return F.coalesce(scan(cells, F.lit(0), step, f"struct<start: int, kind: int, end: int{extra}>"), F.array().cast(f"array<struct<start: int, kind: int, end: int{extra}>>"))


def samples(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_random: int = SAMPLE_RANDOM) -> DataFrame:
    """Labelled samples (sample, random): identifiers of about `sample_docs` documents chosen by a hash of their text, the values that the
    fixed forms find in them, and `sample_random` strings drawn at random from hexadecimal and base64 digits."""
    total = max(1, docs.count())
    picked = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(total)) < sample_docs)
    words = picked.select(F.explode(F.regexp_extract_all("t", F.lit(IDENTIFIER), F.lit(0))).alias("sample"))
    fixed = F.col("sample").rlike("^(?:" + FORMS["hex"][0] + "|" + FORMS["access"][0] + ")$")
    ordinary = words.where(~fixed).select("sample", F.lit(False).alias("random"))
    values = [picked.select(F.explode(F.regexp_extract_all("t", F.lit(p), F.lit(g))).alias("sample")).where(F.char_length("sample") >= n) for p, g, n in FORMS.values()]
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    drawn = docs.sparkSession.range(sample_random).select(F.when(F.col("id") % 2 == 0, digest).otherwise(F.base64(F.unhex(digest))).alias("sample"))
    for v in values:
        drawn = drawn.unionByName(v)
    return ordinary.unionByName(drawn.withColumn("random", F.lit(True)))


def train(labelled: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """One row, `ratio`: for each pair of ALPHABET's characters, row by row, the log ratio of its two transition probabilities."""
    n = len(ALPHABET)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("sample") - 1), lambda i: F.substr("sample", i, F.lit(2)))).alias("pair")
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring("pair", i, 1)) - 1
    seen = labelled.where(F.char_length("sample") > 1).select("random", pair).groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    seen = seen.select(code(1).alias("a"), code(2).alias("b"), "r", "o").where("a >= 0 and b >= 0")
    cells = labelled.sparkSession.range(n * n).select((F.col("id") / n).cast("int").alias("a"), (F.col("id") % n).cast("int").alias("b")).join(seen, ["a", "b"], "left")
    first = cells.groupBy("a").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("ra"), F.coalesce(F.sum("o"), F.lit(0)).alias("oa"))
    p = lambda x, total: (F.coalesce(F.col(x), F.lit(0)) + smoothing) / (F.col(total) + smoothing * n)
    rows = cells.join(first, "a").select("a", "b", F.log(p("r", "ra") / p("o", "oa")).alias("x"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "x"))), lambda c: c["x"]).alias("ratio"))


def pair_ratios(c: Column, ratio: Column) -> Column:
    """The log ratio of each pair of characters of c, in order; c is cut into characters once."""
    n = len(ALPHABET)
    codes = F.transform(F.split(c, ""), lambda x: F.instr(F.lit(ALPHABET), x))
    last = F.greatest(F.char_length(c) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), last), F.slice(codes, F.lit(2), last), lambda x, y: F.element_at(ratio, (x - 1) * n + y))


def likelihood_ratio(candidate: Column, ratio: Column) -> Column:
    """Log-likelihood ratio, random against ordinary, over the candidate's pairs of characters."""
    return F.aggregate(pair_ratios(candidate, ratio), F.lit(0.0), lambda acc, x: acc + x)


PART = "struct<start: int, end: int, at: int, c: string>"


def left_over(runs: Column, fixed: Column) -> Column:
    """Parts (start, end) of the runs (start, kind, end, c) that no span of `fixed` covers, with their run's start `at` and text `c`; one pass over both in order of start."""
    as_run = lambda s, c: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), c.alias("c"))
    end = F.lit(2**31 - 1)
    stop = F.array(F.struct(end.alias("start"), F.lit(len(FORMS)).alias("kind"), end.alias("end"), F.lit("").alias("c")))
    cells = F.concat(F.array_sort(F.concat(F.transform(fixed, lambda s: as_run(s, F.lit(None).cast("string"))), runs)), stop)
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("from"), F.lit(0).alias("end"), F.lit(0).alias("at"), F.lit("").alias("c"))

    def step(st: Column, x: Column):
        is_run = x["kind"] == len(FORMS)
        until = F.least(x["start"], st["end"])
        part = F.when(st["from"] < until, F.struct(st["from"].alias("start"), until.alias("end"), st["at"].alias("at"), st["c"].alias("c")))
        covered = F.greatest(st["covered"], F.when(is_run, F.lit(0)).otherwise(x["end"]))
        pick = lambda new, old: F.when(is_run, new).otherwise(old)
        state = F.struct(covered.alias("covered"), F.greatest(covered, pick(x["start"], st["from"])).alias("from"), pick(x["end"], st["end"]).alias("end"), pick(x["start"], st["at"]).alias("at"), pick(x["c"], st["c"]).alias("c"))
        return state, part

    return scan(cells, zero, step, PART)


STRETCH = "struct<start: int, end: int>"


def stretches(c: Column, ratio: Column, min_ratio: float, min_mean: float) -> Column:
    """Spans (start, end) of the stretches of c that look random.

    One begins where the sum of what pairs have above the mean was last used up, and ends at the sum's peak before it falls by `min_ratio`.
    """
    state = lambda i, start, total, raw, peak, end, kept: F.struct(i.alias("i"), start.alias("start"), total.alias("sum"), raw.alias("raw"), peak.alias("peak"), end.alias("end"), kept.alias("kept"))
    zero = F.lit(0.0)

    def step(acc: Column, x: Column):
        i = acc["i"] + 1
        total, raw = acc["sum"] + x - min_mean, acc["raw"] + x
        cut = x.isNull() | (total < 0) | (total < acc["peak"] - min_ratio)
        long = (acc["kept"] > min_ratio) & (acc["end"] - acc["start"] >= MIN_CHARS)
        then = (F.when(cut, state(i, i, zero, zero, zero, i, zero))
                .when(total > acc["peak"], state(i, acc["start"], total, raw, total, i + 1, raw))
                .otherwise(state(i, acc["start"], total, raw, acc["peak"], acc["end"], acc["kept"])))
        return then, F.when(cut & long, F.struct(acc["start"].alias("start"), acc["end"].alias("end")))

    # a last null closes what is open
    cells = F.concat(pair_ratios(c, ratio), F.array(F.lit(None).cast("double")))
    return scan(cells, state(F.lit(0), F.lit(0), zero, zero, zero, F.lit(0), zero), step, STRETCH)


def united(spans: Column) -> Column:
    """Spans (start, end, in order of start) with those that overlap as one."""
    end = F.lit(2**31 - 1)
    own = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    cells = F.concat(F.transform(spans, lambda s: own(s["start"], s["end"])), F.array(own(end, end)))

    def step(last: Column, s: Column):
        apart = last["end"] <= s["start"]
        return own(F.when(apart, s["start"]).otherwise(last["start"]), F.when(apart, s["end"]).otherwise(F.greatest(last["end"], s["end"]))), F.when(apart & (last["end"] > 0), own(last["start"], last["end"]))

    return scan(cells, own(F.lit(0), F.lit(0)), step, STRETCH)


def find(docs: DataFrame, model: DataFrame, text: str = "text", out: str = "spans", min_ratio: float = MIN_RATIO, min_mean: float = MIN_MEAN) -> DataFrame:
    """docs with `out`: spans (start, kind as a place in KINDS, end) of each whole text in order of start, then kind.

    A random string has no part in a fixed form; what fixed forms leave of a run is scored alone, as a whole first. If that does not look
    random, its pieces between separators and its best stretches are, MIN_CHARS at least. A null or empty text has no spans. Every row is scanned on its own, so
    repeated rows and texts of any length are too. `out` replaces a column of that name.
    """
    rows, names = plain(docs)
    t = F.coalesce(F.col(names[text]), F.lit(""))
    fixed = F.concat(*[matches(found_cells(t, p, g), k, n) for k, (p, g, n) in enumerate(FORMS.values())])
    spans = rows.withColumn("__fixed", fixed).withColumn("__runs", matches(found_cells(t, CANDIDATE), len(FORMS), text=True)).withColumn("__ratio", model.scalar())

    def odd(c: Column) -> Column:
        return likelihood_ratio(c, F.col("__ratio")) > F.greatest(F.lit(min_ratio), (F.char_length(c) - 1) * F.lit(min_mean))

    def within(c: Column) -> Column:
        pieces = F.transform(F.filter(matches(found_cells(c, PIECE), 0, text=True), lambda s: odd(s["c"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.when(odd(c), F.array(F.struct(F.lit(0).alias("start"), F.char_length(c).alias("end")))).otherwise(
            united(F.array_sort(F.concat(pieces, stretches(c, F.col("__ratio"), min_ratio, min_mean)))))

    parts = F.filter(left_over(F.col("__runs"), F.col("__fixed")), lambda p: p["end"] - p["start"] >= MIN_CHARS)
    texts = F.transform(parts, lambda p: F.struct(p["start"].alias("at"), F.substr(p["c"], p["start"] - p["at"] + 1, p["end"] - p["start"]).alias("c")))
    random = F.flatten(F.transform(texts, lambda x: F.transform(within(x["c"]), lambda s: F.struct((x["at"] + s["start"]).alias("start"), F.lit(len(FORMS)).alias("kind"), (x["at"] + s["end"]).alias("end")))))
    spans = spans.withColumn("__fixed", F.array_sort("__fixed"))
    return spans.select(*[F.col(names[c]).alias(c) for c in docs.columns if c != out], F.array_sort(F.concat("__fixed", random)).alias(out))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs with every secret replaced by `<secret>`; spans that overlap are replaced as one. `chars`, if there, follows the text."""
    rows, names = plain(docs)
    found = find(rows, model, names[text], "__spans")
    merged = found.withColumn("__merged", united(F.col("__spans")))
    t = F.col(names[text])
    # the text in pieces, so that a cut looks at its own pieces only
    cut = merged.withColumn("__pieces", F.regexp_extract_all(t, F.lit(f"(?s).{{1,{TEXT_CHUNK}}}"), F.lit(0)))
    piece = lambda i: F.coalesce(F.get("__pieces", i), F.lit(""))

    def between(a: Column, b: Column) -> Column:
        i, j = F.floor(a / TEXT_CHUNK).cast("int"), F.floor(b / TEXT_CHUNK).cast("int")
        whole = F.array_join(F.slice("__pieces", i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return F.when(i == j, F.substr(piece(i), a % TEXT_CHUNK + 1, b - a)).otherwise(F.concat(F.substr(piece(i), a % TEXT_CHUNK + 1, F.lit(TEXT_CHUNK)), whole, F.substr(piece(j), F.lit(1), b % TEXT_CHUNK)))

    past = lambda i: F.coalesce(F.get("__merged", i - 1)["end"], F.lit(0))
    before = F.transform("__merged", lambda s, i: F.concat(between(past(i), s["start"]), F.lit(REDACTED)))
    rest = between(F.try_element_at("__merged", F.lit(-1))["end"], F.char_length(t))
    out = cut.withColumn("__clean", F.when(F.size("__merged") > 0, F.concat(F.array_join(before, ""), rest)).otherwise(t))
    if chars in names:
        length = F.char_length("__clean").cast(docs.schema[chars].dataType)
        out = out.withColumn(names[chars], F.when((F.size("__merged") > 0) & F.col(names[chars]).isNotNull(), length).otherwise(F.col(names[chars])))
    return out.withColumn(names[text], F.col("__clean")).select(*[F.col(names[c]).alias(c) for c in docs.columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the fixed forms, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, train(samples(docs)))
    base = F.filter("spans", lambda s: s["kind"] < len(FORMS))

    def count(kind: int) -> Column:
        # one parameter: F.filter hands a second one the place in the array
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(FORMS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
