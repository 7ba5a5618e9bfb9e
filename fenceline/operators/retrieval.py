"""Retrieval, ranking and the learning loop (Q1-Q23)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import canonical_line, canonical_tokens, const_map, tokenize
from ..session import stored
from ..types import bounded, small_side
from . import blocked, literals

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
MIN_RRF = 0.0150


def doc_tokens(text: Column) -> Column:
    """Lower-case tokens of a document, as the ranker counts them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9._-]*"), F.lit(0))


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, term, tf, dl): one row per distinct term of a document; counted in the row, so no shuffle."""
    d = docs.select("doc_id", tokens.alias("toks")).withColumn("dl", F.size("toks"))
    x = d.select("doc_id", "dl", F.explode("toks").alias("term"))
    return x.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def _top(df: DataFrame, by: str, score: str, k: int, tie: str = "doc_id") -> DataFrame:
    """The k best per query; the rank limit is applied before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc(), tie))).where(F.col("rank") <= k)


def weighted_postings(queries: DataFrame, docs: DataFrame, q_tokens: Column | None = None, d_tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, qtf) and (doc_id, term, w): what terms of the questions weigh in each document by Okapi BM25.

    Documents are cut into tokens once; counts per term and lengths come from the postings, which are written.
    A negative idf is raised to a quarter of the mean idf over the vocabulary.
    """
    qt = queries.select("query_id", F.explode(q_tokens if q_tokens is not None else doc_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    p = stored(postings(docs, d_tokens if d_tokens is not None else doc_tokens(F.col("text"))))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    avgdl = p.agg(F.sum("tf")).scalar() / n
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = df.select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = terms.agg(F.avg("idf").alias("m")).scalar()
    wanted = terms.join(qt.select("term").distinct(), "term", "left_semi").withColumn("idf", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf")))
    w = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    return qt, p.join(wanted, "term").select("doc_id", "term", w.alias("w"))


def bm25_scores(queries: DataFrame, docs: DataFrame, q_tokens: Column | None = None, d_tokens: Column | None = None) -> DataFrame:
    """Q1: Okapi BM25 of every (query, document) sharing a term. queries(query_id, text), docs(doc_id, text).

    One row a pair: where only the best are asked for, `bm25` makes no pairs.
    """
    qt, hits = weighted_postings(queries, docs, q_tokens, d_tokens)
    return qt.join(hits, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qtf")).alias("bm25"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 60, keep: DataFrame | None = None, **tokens) -> DataFrame:
    """Q1: the k best documents per query, by BM25 rounded to nine places, ties to the smaller id.

    Exact, block by block: a common term is added up within a block, and only the k best of a block are shuffled. `keep` (doc_id) names the
    documents that may be answered with (Q5); others count for the statistics and are left out before anything is scored.
    """
    qt, hits = weighted_postings(queries, docs, **tokens)
    hits = hits if keep is None else hits.join(keep.select("doc_id").distinct(), "doc_id", "left_semi")
    return blocked.top_k(qt, hits, blocked.weighted_terms, k, blocked.block_counts(queries.count(), docs.count()), "bm25")


def word_ngrams(toks: Column) -> Column:
    """Words of two or more characters and their neighbours in pairs."""
    w = F.filter(toks, lambda t: F.length(t) >= 2)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(w) >= 2, F.concat(w, pairs)).otherwise(w)


def tfidf_scores(queries: DataFrame, docs: DataFrame, toks=None, above: float | None = None) -> DataFrame:
    """Q2: cosine of word 1-2-gram tf-idf vectors (smooth idf), the vocabulary being the documents'.

    Documents are cut into terms once. With `above`, the pairs of a greater cosine, added up block by block: pairs that merely share a common word are no rows.
    """
    toks = toks or (lambda c: F.filter(F.split(F.lower(c), r"\W+"), lambda t: t != ""))
    p = stored(postings(docs, word_ngrams(toks(F.col("text")))))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = stored(p.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    norm = p.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf")).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = stored(postings(queries.withColumnRenamed("query_id", "doc_id"), word_ngrams(toks(F.col("text")))).join(idf, "term").select(F.col("doc_id").alias("query_id"), "term", "idf", (F.col("tf") * F.col("idf")).alias("qw")))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    d = p.join(q.select("term", "idf").distinct(), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    if above is None:
        dots = q.join(d, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
        return dots.join(norm, "doc_id").join(qn, "query_id").select("query_id", "doc_id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("cosine"))
    unit_q = q.join(qn, "query_id").select("query_id", "term", (F.col("qw") / F.col("qnorm")).alias("qtf"))
    unit_d = d.join(norm, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("w"))
    return blocked.above(unit_q, unit_d, blocked.weighted_terms, above, blocked.block_counts(queries.count(), docs.count()), "cosine")


def hybrid_lexical(queries: DataFrame, examples: DataFrame, k: int = 5) -> DataFrame:
    """Q2: 0.7 cosine + 0.3 damped BM25 over canonical tokens. examples(doc_id, text, ...)."""
    toks = lambda c: canonical_tokens(tokenize(c))
    c = tfidf_scores(queries, examples, toks)
    b = bm25_scores(queries, examples, q_tokens=toks(F.col("text")), d_tokens=toks(F.col("text")))
    s = c.join(b, ["query_id", "doc_id"], "full").select("query_id", "doc_id", (0.7 * F.coalesce("cosine", F.lit(0.0)) + 0.3 * F.least(F.greatest(F.coalesce("bm25", F.lit(0.0)) / 10, F.lit(0.0)), F.lit(1.0))).alias("score"))
    return _top(s.where("score > 0"), "query_id", "score", k)


def unit(v: Column) -> Column:
    """A vector at length one."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / (n + 1e-9))


def dense_rank(queries: DataFrame, vectors: DataFrame, k: int = 25) -> DataFrame:
    """Q3: the k vectors of greatest cosine for every query, rounded to nine places, ties to the smaller id. queries(query_id, embedding), vectors(doc_id, embedding).

    Products of blocks; any number of queries. Vectors that are null or hold a null take no part, and vectors of different length do not meet.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    q = queries.where(whole).select("query_id", unit(F.col("embedding")).alias("v"))
    d = vectors.where(whole).select("doc_id", unit(F.col("embedding")).alias("v"))
    return blocked.top_k(q, d, blocked.products, k, blocked.block_counts(queries.count(), vectors.count()), "sim")


def rrf_fuse(*ranked: DataFrame, k0: int = RRF_K, min_rrf: float = 0.0) -> DataFrame:
    """Q4: sum of 1/(k0 + rank) over the rankings a document appears in. Each ranked has query_id, doc_id, rank."""
    parts = [r.select("query_id", "doc_id", F.lit(i).alias("src"), "rank") for i, r in enumerate(ranked)]
    f = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (k0 + F.col("rank"))).alias("rrf"), *[F.min(F.when(F.col("src") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(ranked))])
    return f.where(F.col("rrf") >= min_rrf)


def platform_match(doc_platform: Column, want: Column) -> Column:
    a, b = F.lower(doc_platform), F.lower(want)
    return doc_platform.isNull() | want.isNull() | a.contains(b) | b.contains(a)


def filter_before_rank(docs: DataFrame, frameworks: list[str] | None = None, platform: str | None = None) -> DataFrame:
    """Q5: candidates are cut before they are ranked, so the pool holds only what can be answered with."""
    if frameworks:
        docs = docs.where(F.col("framework").isin(frameworks))
    return docs.where(platform_match(F.col("platform"), F.lit(platform))) if platform else docs


def collapse(hits: DataFrame, score: str = "rrf") -> DataFrame:
    """Q6: one item per (framework, title, control) and query, the best ranked; how many others said the same."""
    title = F.lower(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("text")))
    cols = [c for c in hits.columns if c not in ("query_id", "framework", "control_id")]
    g = hits.withColumn("__t", title).groupBy("query_id", "framework", "control_id", "__t").agg(
        F.max_by(F.struct(*cols), F.struct(F.col(score), F.expr("-doc_id") if dict(hits.dtypes)["doc_id"] in ("bigint", "int") else F.col("doc_id"))).alias("h"), (F.count(F.lit(1)) - 1).alias("also_in"))
    return g.select("query_id", "framework", "control_id", "h.*", "also_in")


def confidence(hits: DataFrame) -> DataFrame:
    """Q7: 100 x (0.45 similarity + 0.55 spread margin) x type fit; only the first of a query has a margin. hits(query_id, doc_id, sim, rank, type_mult)."""
    w = W.partitionBy("query_id").orderBy("rank")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    m = F.when(F.col("rank") == 1, F.coalesce(F.col("sim") - F.lead("sim").over(w), F.lit(0.0))).otherwise(F.lit(0.0))
    h = hits.withColumn("margin", m)
    return h.withColumn("confidence", 100.0 * (0.45 * clip(F.col("sim")) + 0.55 * clip(F.col("margin") * 4.0)) * clip(F.col("type_mult")))


def needs_rerank(hits: DataFrame, margin: float = 0.25) -> DataFrame:
    """Q8: queries whose two best are too close to call. hits(query_id, score, rank)."""
    w = W.partitionBy("query_id").orderBy("rank")
    h = hits.withColumn("second", F.lead("score").over(w)).where("rank = 1")
    return h.select("query_id", F.when(F.col("second").isNull(), False).when(F.col("score") <= 0, True).otherwise((F.col("score") - F.col("second")) / F.col("score") < margin).alias("needs_rerank"))


# Scores above which a line is answered, or worth asking a model about.
ACCEPT, ESCALATE, ONE_CLICK = 0.60, 0.20, 0.50


def route(lines: DataFrame, registry: DataFrame, hits: DataFrame) -> DataFrame:
    """Q9: the tier that answers each line. lines(query_id, text, quarantined), registry(platform, text, field), hits(query_id, rank, score, field)."""
    known = registry.select(canonical_line(F.col("text")).alias("key"), "field").groupBy("key").agg(F.min("field").alias("known_field"))
    top = hits.where("rank = 1").select("query_id", "score", F.col("field").alias("top_field"))
    j = lines.withColumn("key", canonical_line(F.col("text"))).join(known, "key", "left").join(top, "query_id", "left")
    s = F.coalesce("score", F.lit(0.0))
    tier = F.when(F.col("quarantined"), 4).when(F.col("known_field").isNotNull(), 1).when(s >= ACCEPT, 2).when(s >= ESCALATE, 3).otherwise(4)
    return j.withColumn("tier", tier).select("query_id", "tier", F.when(F.col("tier") == 1, F.col("known_field")).when(F.col("tier") == 2, F.col("top_field")).alias("field"),
                                            (F.col("tier") != 1).alias("needs_human"), ((F.col("tier") == 1) | ((F.col("tier") == 2) & (s >= ONE_CLICK))).alias("one_click_ok"))


def disambiguate(examples: DataFrame) -> DataFrame:
    """Q10: one label per line: most leaf words on the line, then most field words, then the shorter name. examples(line, field, ordinal)."""
    lt = canonical_tokens(tokenize(F.col("line")))
    ft = canonical_tokens(tokenize(F.regexp_replace("field", r"\.", " ")))
    leaf = canonical_tokens(tokenize(F.element_at(F.split("field", r"\."), -1)))
    n = lambda t: F.size(F.array_distinct(F.array_intersect(t, lt)))
    e = examples.withColumn("k", F.struct(n(leaf).alias("a"), n(ft).alias("b"), (-F.length("field")).alias("c"), (-F.col("ordinal")).alias("d")))
    return e.groupBy("line").agg(F.max_by("field", "k").alias("field"), F.count(F.lit(1)).alias("labels"))


def corpus_from_packs(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """Q11: every (line, field) a mapping's regex produces over sample lines, once each. mappings(ordinal, vendor, field, regex)."""
    d = lines.select(F.rtrim("text").alias("text")).where("trim(text) != ''").distinct()
    j = literals.called_up(d, F.col("text"), literals.indexed(mappings, "regex"), []).where(F.expr("rlike(trim(text), regex) or rlike(text, regex)"))
    return j.groupBy(F.trim("text").alias("line"), "field").agg(F.min("ordinal").alias("ordinal"))


# Framework vocabulary of a field-name word.
EXPANSIONS = {
    "http": "http web browser administrative interface plaintext unencrypted", "https": "https tls encrypted web administrative interface", "ssh": "ssh secure shell remote administrative access",
    "telnet": "telnet plaintext unencrypted remote access protocol", "snmp": "snmp simple network management protocol community string monitoring", "aaa": "aaa authentication authorization accounting centralised identity",
    "mfa": "multi-factor two-factor authentication token", "vty": "vty virtual terminal line remote console session", "banner": "banner login message legal notice warning consent",
    "ntp": "ntp network time protocol clock synchronisation timestamp", "syslog": "syslog remote logging collector audit record", "logging": "logging audit records event log retention",
    "lockout": "account lockout failed login attempts threshold", "timeout": "idle session timeout automatic disconnect inactivity", "crypto": "cryptography cipher algorithm key exchange encryption strength",
    "ciphers": "weak deprecated cipher algorithm des md5 sha1 rc4", "exposure": "exposed reachable from the internet public network untrusted", "firewall": "firewall access control list rule policy permit deny",
    "enabled": "enabled disabled turned on off configured", "version": "protocol version supported deprecated", "password": "password credential complexity minimum length policy",
    "accounts": "user account emergency break glass credential", "role": "role based access control least privilege separation of duties",
}


def build_probes(syntax: DataFrame) -> DataFrame:
    """Q12: one probe per field: its words, what frameworks call them, and every vendor's syntax in pack order. syntax(field, raw, ordinal)."""
    s = syntax.where("trim(raw) != ''").withColumn("field", F.split_part("field", F.lit("["), F.lit(1)))
    g = s.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "raw"))), lambda x: x["raw"]).alias("raws"))
    words = F.split(F.regexp_replace("field", r"\.", "_"), "_")
    m = const_map(EXPANSIONS)
    said = F.filter(F.transform(words, lambda w: m[w]), lambda x: x.isNotNull())
    intent = F.regexp_replace("field", r"[._]", " ")
    return g.select("field", F.split_part("field", F.lit("."), F.lit(1)).alias("domain"), F.concat_ws(" ", F.array(intent), said, "raws").alias("query_text"), F.size("raws").alias("n_syntax"))


def propose(hits: DataFrame, docs: DataFrame, chain: DataFrame, per_framework: int = 3) -> DataFrame:
    """Q13: proposals per probe: the best retrieved STIG and CIS items, NIST and ISO by the authoritative chain (NIST retrieved where it gives none).

    hits(query_id, doc_id, rrf), docs(doc_id, framework, control_id), chain from frameworks.provenance_chain.
    """
    h = hits.join(docs.select("doc_id", "framework", "control_id"), "doc_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id", "framework").orderBy(F.col("rrf").desc(), "doc_id"))).where(F.col("rank") <= per_framework)
    got = h.where("framework in ('stig', 'cis')").select(F.col("query_id").alias("probe"), "framework", "control_id", F.col("rrf").alias("score"), F.lit("retrieval").alias("via"))
    derived = chain.select("probe", "framework", F.col("target").alias("control_id"), "score", F.lit("chain").alias("via"))
    back = h.where("framework = 'nist_800_53'").select(F.col("query_id").alias("probe"), "framework", "control_id", F.col("rrf").alias("score"), F.lit("retrieval").alias("via")).join(
        chain.where("framework = 'nist_800_53'").select("probe").distinct(), "probe", "left_anti")
    return got.unionByName(derived).unionByName(back)


def proposal_coverage(proposals: DataFrame, probes: DataFrame) -> DataFrame:
    """Q13: share of probes with a proposal, per framework."""
    n = probes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return proposals.groupBy("framework").agg(F.count_distinct("probe").alias("fields")).withColumn("pct", 100.0 * F.col("fields") / n)


def training_queue(records: DataFrame, decisions: DataFrame | None = None, only_security: bool = True) -> DataFrame:
    """Q14: unmapped settings by name: how often, up to five sample values in first-seen order, first evidence, decision.

    records(device_id, platform, ordinal, path, value, raw) already without what a mapping consumed. Values are folded
    per name before samples are taken, so a setting on every device is never gathered whole.
    """
    from ..functions.text import base_name, classify_setting
    r = records.where(classify_setting(F.col("path"), F.col("value")) == "security-relevant") if only_security else records
    r = r.withColumn("name", F.when(F.col("path").contains("."), F.col("path")).otherwise(base_name(F.col("path"))))
    key = ["device_id", "platform", "name"]
    v = r.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("at"), F.min_by("raw", "ordinal").alias("raw"))
    s5 = v.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("at"))).where("k <= 5").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("samples"))
    t = v.groupBy(*key).agg(F.sum("n").alias("occurrences"), F.min("at").alias("evidence_at"), F.min_by("raw", "at").alias("evidence"))
    q = t.join(s5, key)
    if decisions is None:
        return q.withColumn("status", F.lit("PENDING"))
    d = decisions.select("platform", "name", "decision")
    return q.join(d, ["platform", "name"], "left").where("coalesce(decision, '') != 'rejected'").withColumn("status", F.when(F.col("decision") == "approved", "APPROVED").otherwise("PENDING")).drop("decision")


def json_table_records(files: DataFrame) -> DataFrame:
    """Q15: a table-shaped JSON configuration: keys of a table of objects as values, its fields as TABLE.*.field."""
    top = files.select("device_id", F.explode(F.from_json("content", "map<string,string>")).alias("tab", "body")).where(~F.col("tab").startswith("_"))
    obj = F.col("body").startswith("{")
    t = top.withColumn("kids", F.when(obj, F.from_json("body", "map<string,string>")))
    of_objects = obj & (F.size("kids") > 0) & F.forall(F.map_values("kids"), lambda v: v.startswith("{"))
    t = t.withColumn("oo", F.coalesce(of_objects, F.lit(False)))
    scalar = lambda c: ~c.startswith("{") & ~c.startswith("[") & (c != "null")
    rows = t.where("oo").select("device_id", "tab", F.explode("kids").alias("key", "child"))
    keys = rows.select("device_id", F.col("tab").alias("name"), F.col("key").alias("value"), F.lit("keys").alias("kind"))
    inner = rows.select("device_id", "tab", F.explode(F.from_json("child", "map<string,string>")).alias("f", "v")).where(scalar(F.col("v"))).select("device_id", F.concat("tab", F.lit(".*."), "f").alias("name"), F.col("v").alias("value"), F.lit("value").alias("kind"))
    flat = t.where("not oo and kids is not null").select("device_id", "tab", F.explode("kids").alias("f", "v")).where(scalar(F.col("v"))).select("device_id", F.concat_ws(".", "tab", "f").alias("name"), F.col("v").alias("value"), F.lit("value").alias("kind"))
    plain = t.where("kids is null").where(scalar(F.col("body"))).select("device_id", F.col("tab").alias("name"), F.col("body").alias("value"), F.lit("value").alias("kind"))
    return keys.unionByName(inner).unionByName(flat).unionByName(plain)


def conflicts(approvals: DataFrame) -> DataFrame:
    """Q16: equivalent lines mapped to different fields. One row per line and field, beside the fields others chose; linear in approvals."""
    a = approvals.withColumn("key", canonical_line(F.col("line"))).groupBy("key", "field").agg(F.count(F.lit(1)).alias("n"))
    k = a.groupBy("key").agg(F.count(F.lit(1)).alias("fields"), F.min("field").alias("first_field")).where("fields > 1")
    return a.join(k, "key")


def record_hash() -> Column:
    """Q17: a record's hash over its content and the previous hash, keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(F.col("approved_at").alias("at"), F.col("approved_by").alias("by"), "field", "line", "platform", F.col("prev_hash").alias("prev"), "value", "vendor"), {"ignoreNullFields": "false"}), 256)


def verify_chain(approvals: DataFrame, by: str = "log_id", stretch: int = 65536) -> DataFrame:
    """Q17: per log, whether every record carries the hash before it, and the first that does not.

    Checked in two levels: within stretches of `stretch` sequence numbers, each a task's matter, then each stretch's first record against the last
    hash of the stretch before it. A hash that is missing is a broken one.
    """
    w = W.partitionBy(by, "__s").orderBy("seq")
    a = approvals.withColumn("__s", F.floor(F.col("seq") / stretch))
    a = a.withColumn("__n", F.row_number().over(w)).withColumn("__prev", F.lag("record_hash").over(w))
    wrong = ~F.col("record_hash").eqNullSafe(record_hash()) | ((F.col("__n") > 1) & ~F.col("prev_hash").eqNullSafe(F.col("__prev")))
    head = F.col("__n") == 1
    # a hash may be missing, and a null struct field is kept where a null value is not
    parts = a.groupBy(by, "__s").agg(F.min(F.when(wrong, F.col("seq"))).alias("within"), F.count_if(wrong).alias("bad"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"),
                                     F.max(F.when(head, F.struct("prev_hash"))).alias("head"), F.max_by(F.struct("record_hash"), "__n").alias("tail"))
    before = F.lag(F.struct(F.col("tail.record_hash").alias("h"))).over(W.partitionBy(by).orderBy("__s"))
    cut = ~F.col("head.prev_hash").eqNullSafe(F.when(before.isNull(), F.lit("")).otherwise(before["h"]))
    parts = parts.withColumn("__cut", cut)
    return parts.groupBy(by).agg(F.min(F.least("within", F.when(F.col("__cut"), F.col("first")))).alias("first_broken"), F.sum("n").alias("records"), (F.sum("bad") + F.count_if("__cut") == 0).alias("intact"))


def regression_gate(expected: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Q18: whether a change may pass: nothing that was right may turn wrong, and a rise in the pass rate raises an alert. All keyed (case, control_id, state)."""
    b, a = before.select("case", "control_id", F.col("state").alias("b")), after.select("case", "control_id", F.col("state").alias("a"))
    j = expected.select("case", "control_id", F.col("state").alias("e")).join(b, ["case", "control_id"], "left").join(a, ["case", "control_id"], "left")
    broken = j.agg(F.count_if((F.col("b") == F.col("e")) & (F.coalesce("a", F.lit("MISSING")) != F.col("e"))).alias("broken"), F.count_if((F.col("b") == F.col("e")) & (F.col("e") == "FAIL") & (F.col("a") == "PASS")).alias("flipped"))
    rate = lambda df: F.when(F.count_if(F.col("state").isin("PASS", "FAIL", "PARTIAL")) > 0, 100.0 * F.count_if(F.col("state") == "PASS") / F.count_if(F.col("state").isin("PASS", "FAIL", "PARTIAL"))).otherwise(0.0)
    rb, ra = before.agg(rate(before).alias("r")).scalar(), after.agg(rate(after).alias("r")).scalar()
    return broken.withColumns({"pass_rate_before": rb, "pass_rate_after": ra}).withColumn("allowed", F.col("broken") == 0).withColumn("direction_alert", F.col("pass_rate_after") > F.col("pass_rate_before") + 0.01)


def verify_golden(expected: DataFrame, actual: DataFrame, cases: DataFrame) -> DataFrame:
    """Q19: expectations that hold, mismatch, are missing, or whose configuration is not there. cases(case) lists those present."""
    j = (expected.select("case", "control_id", F.col("state").alias("want")).join(actual.select("case", "control_id", F.col("state").alias("got")), ["case", "control_id"], "left")
         .join(cases.select("case", F.lit(True).alias("there")), "case", "left"))
    return j.select("case", "control_id", F.when(F.col("there").isNull(), "no_config").when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("want"), "mismatch").otherwise("ok").alias("result"))


def diff_mapping_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Q20: samples that came or went, and fields whose value changed. Tables of (sample, field, value)."""
    o, n = old.select("sample").distinct().withColumn("o", F.lit(True)), new.select("sample").distinct().withColumn("n", F.lit(True))
    s = o.join(n, "sample", "full")
    came = s.where("o is null or n is null").select("sample", F.lit("").alias("field"), F.when(F.col("o").isNull(), "new_sample").otherwise("removed_sample").alias("change"))
    both = s.where("o and n").select("sample")
    f = old.join(both, "sample", "left_semi").select("sample", "field", F.col("value").alias("ov")).join(new.join(both, "sample", "left_semi").select("sample", "field", F.col("value").alias("nv")), ["sample", "field"], "full")
    return came.unionByName(f.where("not (ov <=> nv)").select("sample", "field", F.lit("changed").alias("change")))


def topk_accuracy(ranked: DataFrame, gold: DataFrame, fold: str) -> DataFrame:
    """Q21: share of queries whose answer is first, and among the first five, per fold and overall. ranked(query_id, field, rank), gold(query_id, fold, field)."""
    hit = ranked.join(gold.select("query_id", "field"), ["query_id", "field"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    j = gold.select("query_id", fold).join(hit, "query_id", "left")
    return j.groupingSets([[fold], []], fold).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") == 1).alias("top1"), F.count_if(F.col("r") <= 5).alias("top5")).withColumn(fold, F.coalesce(F.col(fold), F.lit("ALL")))


def leave_one_out(examples: DataFrame, fold: str) -> DataFrame:
    """Q21: for each fold the examples of all the others, as (held_out, example): the folds are few and checked."""
    folds = bounded(examples.select(fold).distinct(), 1000, "folds").agg(F.collect_list(fold).alias("f")).scalar()
    return examples.withColumn("held_out", F.explode(folds)).where(F.col("held_out") != F.col(fold))


# Confidence bands, and the thresholds asked about.
BANDS = [(80, 101), (60, 80), (40, 60), (20, 40), (0, 20)]
THRESHOLDS = [80, 70, 60, 50, 40, 30]


def precision_by_band(pred: DataFrame) -> DataFrame:
    """Q22: predictions per confidence band, how many were right, and the running share from the top. pred(confidence, correct)."""
    band = None
    for lo, hi in BANDS:
        c = (F.col("confidence") >= lo) & (F.col("confidence") < hi)
        band = F.when(c, lo) if band is None else band.when(c, lo)
    g = pred.withColumn("low", band).where("low is not null").groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"))
    return g.withColumn("seen", F.sum("n").over(W.orderBy(F.col("low").desc()).rowsBetween(W.unboundedPreceding, 0)))


def threshold_curve(pred: DataFrame) -> DataFrame:
    """Q22: what is kept above each threshold and how much of it is right, in one pass."""
    one = pred.agg(F.count(F.lit(1)).alias("total"), *[x for t in THRESHOLDS for x in (F.count_if(F.col("confidence") >= t).alias(f"n{t}"), F.count_if((F.col("confidence") >= t) & F.col("correct")).alias(f"c{t}"))])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("n"), F.col(f"c{t}").alias("correct"), (F.col("total") - F.col(f"n{t}")).alias("remaining")) for t in THRESHOLDS])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def fleet(devices: DataFrame, scores: DataFrame, framework_scores: DataFrame, frameworks: list[str]) -> DataFrame:
    """Q23: one row per device with its scores and a column per framework."""
    fw = framework_scores.groupBy("device_id").pivot("framework", frameworks).agg(F.first("framework_score_pct"))
    return devices.join(scores, "device_id", "left").join(fw, "device_id", "left")


# ------------------------------------------------------------------ licence gate and proposals

def exportable(docs: DataFrame) -> DataFrame:
    """Entries that may only be cited lose their text and title."""
    free = F.col("license") == "public_domain"
    return docs.withColumn("text", F.when(free, F.col("text"))).withColumn("title", F.when(free, F.col("title"))).withColumn("note", F.when(~free, "cited by identifier only"))


def assert_exportable(docs: DataFrame) -> DataFrame:
    """Fails the job when a row that may only be cited still carries text."""
    bad = (F.col("license") == "identifier_only") & F.coalesce(F.col("text") != "", F.lit(False))
    return docs.where(F.when(bad, F.raise_error(F.lit("refusing to export text that may only be cited")).cast("boolean")).otherwise(F.lit(True)))


def validate_proposals(proposals: DataFrame, fields: DataFrame) -> DataFrame:
    """P25: the first reason a proposal is not usable. proposals(line, field, value, evidence), fields(field, type)."""
    from ..functions.text import anchored
    from ..functions.values import normalise
    f = small_side(fields.select("field", F.col("type").alias("want")), 100000)
    j = proposals.join(f, "field", "left")
    v = normalise(F.col("value"), F.col("want"))
    why = (F.when(F.col("field").isNull(), "abstained").when(F.col("want").isNull(), "field not whitelisted").when(~anchored(F.col("evidence"), F.col("line")), "evidence not anchored")
           .when(v.isNull() & F.col("value").isNotNull(), "value not coercible"))
    return j.withColumn("rejected_reason", why).drop("want")


# Structural words of a field name that say nothing about a line.
STRUCTURAL = ["management", "authentication", "authorization", "device", "crypto", "platform", "security", "services", "cloud", "exposure", "firewall", "interfaces", "rules"]


def semantic_sanity(line: Column, field: Column, value: Column) -> Column:
    """The line shares a word with the field, and the value is on the line."""
    lt = canonical_tokens(tokenize(line))
    ft = F.array_except(canonical_tokens(tokenize(F.regexp_replace(field, r"\.", " "))), F.array(*[F.lit(w) for w in STRUCTURAL]))
    related = (F.size(ft) == 0) | F.arrays_overlap(lt, ft)
    return related & (value.isNull() | F.lower(line).contains(F.lower(value)))
