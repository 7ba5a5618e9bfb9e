"""Temperature mixing of sources: token shares to a power, the power bisected to a target, weights realised as block permutations.

All steps are DataFrame operations; the driver sees one small row of figures for each exponent it tries.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .store import plain, written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Documents of a block, the unit that is permuted; exponents tried at once and rounds, each of which narrows the bracket so many times.
BLOCK_DOCS = 4096
GRID, ROUNDS = 16, 6


@dataclass(frozen=True)
class Target:
    """entropy: share of the largest possible entropy that the weights shall have at least. max_epochs: most times that a source may be
    read. Both: the larger exponent of the two. budget: tokens to emit; None: as few as read every source once at least."""

    entropy: float | None = None
    max_epochs: float | None = None
    budget: float | None = None


def hashed(*parts: Column) -> Column:
    """A hexadecimal digest that orders rows as if at random."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def totals(sized: DataFrame) -> DataFrame:
    """tokens, documents and share of each source (__s) of a table with __n."""
    per = sized.groupBy("__s").agg(F.sum("__n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    return written(per, "sources")


def exponent(shares: DataFrame, total: float, target: Target) -> float:
    """The exponent in [0, 1] that meets the target, by bracketing; 1 leaves the shares as they are, 0 makes all weights equal."""
    p = shares.where("tokens > 0").select((F.col("tokens") / total).alias("p"))
    scale = None if target.budget is None else target.budget / total

    def met(lo: float, hi: float) -> list[tuple[float, bool, bool]]:
        tries = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
        power = F.pow("p", F.col("a"))
        rows = p.select("p", F.explode(F.array(*[F.lit(a) for a in tries])).alias("a")).groupBy("a").agg(
            F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("e"), F.max(power / F.col("p")).alias("most"), F.min(power / F.col("p")).alias("least"), F.count(F.lit(1)).alias("k"))
        epochs = F.col("most") / F.col("least") if scale is None else scale * F.col("most") / F.col("z")
        out = rows.select("a", (F.log("z") - F.col("a") * F.col("e") / F.col("z") >= (target.entropy or 0.0) * F.log("k") - 1e-12).alias("h"), (epochs <= (target.max_epochs or float("inf")) + 1e-12).alias("r")).orderBy("a").collect()
        return [tuple(r) for r in out]

    def bracket(which: int, low_is_met: bool) -> float:
        """The last exponent that meets the target on its side: entropy is met up to it, the repetition limit from it on."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = met(lo, hi)
            if not rows:
                return 1.0
            ok = [r[0] for r in rows if r[which]]
            if low_is_met:
                best = max(ok, default=lo)
                lo, hi = best, min([r[0] for r in rows if r[0] > best], default=best)
            else:
                best = min(ok, default=hi)
                lo, hi = max([r[0] for r in rows if r[0] < best], default=best), best
            if lo == hi:
                break
        return lo if low_is_met else hi

    wanted = [bracket(1, True)] if target.entropy is not None else []
    wanted += [bracket(2, False)] if target.max_epochs is not None else []
    return max(wanted, default=1.0)


def weights(per: DataFrame, target: Target) -> DataFrame:
    """Per source: tokens, docs, exponent, weight (they sum to one), goal in tokens, whole epochs and the tokens left for the last one.

    Sources without tokens have weight 0 and are read once. With a budget that no exponent brings under max_epochs the goal is cut to
    max_epochs times the source.
    """
    total = float(per.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    if total == 0:
        return per.select("*", F.lit(1.0).alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("goal"), F.lit(1).cast("long").alias("epochs"), F.lit(0.0).alias("left"))
    a = exponent(per, total, target)
    z = per.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / total, F.lit(a))).alias("z"), F.min(F.pow(F.col("tokens") / total, F.lit(a - 1.0))).alias("least")).first()
    budget = target.budget if target.budget is not None else total * z["z"] / z["least"]
    w = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(a)) / z["z"]).otherwise(0.0)
    goal = F.least(w * budget, F.col("tokens") * target.max_epochs) if target.max_epochs is not None else w * budget
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens") + 1e-9)).otherwise(1).cast("long")
    out = per.withColumn("exponent", F.lit(a)).withColumn("weight", w).withColumn("goal", goal).withColumn("epochs", epochs)
    return out.withColumn("left", F.greatest(F.floor(F.col("goal") - F.col("epochs") * F.col("tokens") + 1e-6), F.lit(0)).cast("double"))  # sizes are whole


def mix(docs: DataFrame, target: Target, source: str = "source", text: str = "text", key: str = "doc_id", size: Column | None = None, seed: int = 7,
        block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs as often as the mixture reads them, with all their columns and __epoch, __n (size), __weight, __exponent and __place.

    The size of a row is its number of words unless given. A source's documents fall into blocks; each epoch permutes the blocks and the
    documents of each. Whole epochs read everything; the last one stops before the document that would exceed the source's goal, found
    from sums per block and running sums within one. __place (0 to 1) orders the mixture. A null source is a source of its own; rows
    without words are read in whole epochs like others; equal rows are rows of their own; an empty table gives an empty one.
    """
    rows, names = plain(docs if size is None else docs.withColumn("__size", size))
    n = F.col(names["__size"]) if size is not None else F.regexp_count(F.coalesce(F.col(names[text]), F.lit("")), F.lit(WORD))
    name = F.coalesce(F.concat(F.lit("="), F.col(names[source]).cast("string")), F.lit(""))
    key = names[key]
    sized = rows.select("*", n.cast("long").alias("__n"), name.alias("__s"))
    per = weights(totals(sized), target).select("__s", F.col("weight").alias("__weight"), F.col("exponent").alias("__exponent"), "tokens", "docs", "goal", "epochs", "left")
    block = F.conv(F.substring(hashed(F.lit(seed), F.col(key)), 1, 8), 16, 10).cast("long") % F.ceil(F.col("docs") / block_docs)
    dealt = sized.join(per, "__s").withColumn("__block", block)

    reads = F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - F.when(F.col("left") > 0, 0).otherwise(1)))
    blocks = dealt.groupBy("__s", "__block").agg(F.sum("__n").alias("size"), *[F.first(c).alias(c) for c in ("tokens", "epochs", "left", "goal")]).where("epochs > 0 or left > 0")
    blocks = blocks.select("*", reads.alias("__epoch"))
    order = W.partitionBy("__s", "__epoch").orderBy(hashed(F.lit(seed), F.col("__s"), F.col("__epoch"), F.col("__block")), "__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("__s", "__block", "__epoch", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("start"))

    rows = dealt.join(blocks, ["__s", "__block"])
    rows = rows.where((F.col("__epoch") < F.col("epochs")) | (F.col("start") < F.col("left")))
    within = W.partitionBy("__s", "__block", "__epoch").orderBy(hashed(F.lit(seed), F.col("__epoch"), F.col(key)), key).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__end", F.col("start") + F.sum("__n").over(within))
    rows = rows.where((F.col("__epoch") < F.col("epochs")) | (F.col("__end") <= F.col("left")))
    place = F.when(F.col("goal") > 0, (F.col("__epoch") * F.col("tokens") + F.col("__end") - F.col("__n")) / F.col("goal")).otherwise(0.0)
    return rows.select(*[F.col(names[c]).alias(c) for c in docs.columns], "__epoch", "__n", "__weight", "__exponent", place.alias("__place"))


def mixing_sql(max_epochs: float, seed: int = 7, block_docs: int = BLOCK_DOCS) -> str:
    """The same question in plain SQL for a repetition limit and no budget: one step of the bracketing is one round of tables."""
    steps = ["r0 AS (SELECT CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi)"]
    for k in range(1, ROUNDS + 1):
        steps.append(f"g{k} AS (SELECT lo + (hi - lo) * i / {GRID}.0 AS a FROM r{k - 1}, range(0, {GRID + 1}) t(i))")
        steps.append(f"e{k} AS (SELECT a, max(pow(p, a) / p) / min(pow(p, a) / p) <= {max_epochs} + 1e-12 AS ok FROM g{k}, p GROUP BY a)")
        steps.append(f"b{k} AS (SELECT coalesce(min(a) FILTER (ok), (SELECT hi FROM r{k - 1})) AS best FROM e{k})")
        steps.append(f"r{k} AS (SELECT coalesce(max(a) FILTER (a < best), max(best)) AS lo, max(best) AS hi FROM e{k}, b{k})")
    return f"""WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
 per AS (SELECT s, CAST(sum(n) AS DOUBLE) AS tokens, count(*) AS docs FROM d GROUP BY 1), tot AS (SELECT sum(tokens) AS total FROM per), p AS (SELECT tokens / total AS p FROM per, tot WHERE tokens > 0),
 {", ".join(steps)}, x AS (SELECT hi AS a FROM r{ROUNDS}),
 z AS (SELECT a, sum(pow(p, a)) AS z, min(pow(p, a - 1)) AS low FROM p, x GROUP BY a),
 w AS (SELECT per.*, a, CASE WHEN tokens > 0 THEN pow(tokens / total, a) / z ELSE 0 END AS weight, least(CASE WHEN tokens > 0 THEN pow(tokens / total, a) / z ELSE 0 END * (total * z / low), tokens * {max_epochs}) AS goal FROM per, tot, z),
 v AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(goal / tokens + 1e-9) AS BIGINT) ELSE 1 END AS epochs FROM w),
 u AS (SELECT *, greatest(floor(goal - epochs * tokens + 1e-6), 0) AS rest FROM v),
 c AS (SELECT d.doc_id, d.source, d.n, u.*, CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % CAST(ceil(docs / {block_docs}.0) AS BIGINT) AS block FROM d JOIN u ON u.s = d.s),
 bs AS (SELECT s, block, sum(n) AS size, any_value(epochs) AS epochs, any_value(rest) AS rest FROM c GROUP BY 1, 2),
 be AS (SELECT s, block, size, unnest(range(0, epochs + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM bs),
 bo AS (SELECT s, block, epoch, coalesce(sum(size) OVER (PARTITION BY s, epoch ORDER BY md5('{seed}|' || s || '|' || epoch || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM be),
 f AS (SELECT c.*, epoch, start + sum(n) OVER (PARTITION BY c.s, c.block, epoch ORDER BY md5('{seed}|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS til
  FROM c JOIN bo ON bo.s = c.s AND bo.block = c.block)
 SELECT doc_id, source, epoch, n AS n_words, round(weight, 6) AS weight, round(a, 6) AS exponent, round(CASE WHEN goal > 0 THEN (epoch * tokens + til - n) / goal ELSE 0 END, 6) AS place
 FROM f WHERE epoch < epochs OR til <= rest"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the flattest mixture that reads none more than 1.5 times reads it; all are read once at least."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    got = mix(docs, Target(max_epochs=1.5))
    return got.select("doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__n").alias("n_words"), F.round("__weight", 6).alias("weight"), F.round("__exponent", 6).alias("exponent"), F.round("__place", 6).alias("place"))
