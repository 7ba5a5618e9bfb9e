"""Firewall logs: parsing, activity and corroboration with counters (L1-L3)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Action words in the order they are looked for, and the spellings of each field.
ACTION_WORDS = [("allow", "allow"), ("permit", "allow"), ("accept", "allow"), ("built", "allow"), ("deny", "deny"), ("drop", "deny"),
                ("denied", "deny"), ("block", "deny"), ("teardown", "allow")]
ALIASES = {"rule_id": ["rule", "ruleid", "policyid", "policy"], "src": ["src", "srcip", "source"], "dst": ["dst", "dstip", "destination"],
           "port": ["dstport", "dport", "port"], "protocol": ["proto", "protocol"]}
KV = r'(\w+)=("([^"]*)"|\S+)'
ASA = r"%ASA-\d-(\d+):"


def with_event(lines: DataFrame, year: int, text: str = "value") -> DataFrame:
    """L1: lines with `e`, one struct per line, batch or stream; NULL where the line is not an event.

    The key=value pairs of a line are extracted once, to two arrays in reverse order; a spelling's last value is a lookup in them.
    """
    line = F.col(text)
    pairs = F.reverse(F.regexp_extract_all(line, F.lit(KV), F.lit(0)))
    d = lines.withColumn("__kv", pairs)
    d = d.withColumn("__k", F.transform("__kv", lambda p: F.substring_index(p, "=", 1)))
    d = d.withColumn("__v", F.transform("__kv", lambda p: F.regexp_replace(p, r'^\w+="*|"+$', "")))

    def get(names) -> Column:
        """The last value given for a spelling; the first non-empty spelling wins."""
        return F.coalesce(*[F.nullif(F.get("__v", F.array_position("__k", n).cast("int") - 1), F.lit("")) for n in names], F.lit(""))

    said = F.regexp_extract_all(F.lower(line), F.lit(r"\b(" + "|".join(w for w, _ in ACTION_WORDS) + r")\b"), F.lit(1))
    d = d.withColumns({f"__{k}": get(v) for k, v in {**ALIASES, "action": ["action"]}.items()})
    d = d.withColumn("__said", F.when(F.col("__action") == "", said))
    word = F.coalesce(*[F.when(F.array_contains("__said", w), a) for w, a in ACTION_WORDS], F.lit(""))
    iso = F.nullif(F.regexp_extract(line, r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1), F.lit(""))
    sys = F.nullif(F.regexp_extract(line, r"^(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})", 1), F.lit(""))
    sys_ts = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(sys, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    ts = F.coalesce(F.try_to_timestamp(F.replace(iso, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")), sys_ts)
    ok = (F.col("__rule_id") != "") | (F.col("__src") != "") | (F.col("__dst") != "") | line.rlike(ASA)
    e = F.when(F.coalesce(ok & (F.trim(line) != ""), F.lit(False)), F.struct(
        ts.alias("ts"), F.col("__rule_id").alias("rule_id"), F.when(F.col("__action") != "", F.col("__action")).otherwise(word).alias("action"),
        *[F.col(f"__{k}").alias(k) for k in ("src", "dst", "port", "protocol")], F.trim(line).alias("raw")))
    return d.select(*lines.columns, e.alias("e"))


def parse_logs(lines: DataFrame, year: int, text: str = "value") -> DataFrame:
    """L1: every line with its event; parsed is FALSE for a non-blank line that is no event."""
    e = with_event(lines.where(F.trim(F.col(text)) != ""), year, text)
    return e.withColumn("parsed", F.col("e").isNotNull()).select(*[c for c in lines.columns if c != text], "parsed", "e.*")


def summarise_logs(events: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """L2: (totals, per-rule activity)."""
    by = by or []
    # both results come from one aggregate per rule id, which the plan computes once
    rule = F.when(F.col("parsed"), F.coalesce("rule_id", F.lit("")))
    per = events.groupBy(*by, rule.alias("rule_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("parsed") & F.col("ts").isNull()).alias("undated"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    known = F.col("rule_id").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    tot = per.groupBy(*by).agg(
        total(F.when(known, F.col("n"))).alias("events"), total(F.when(~known, F.col("n"))).alias("unparsed"), total("undated").alias("undated"),
        F.min("first_seen").alias("first"), F.max("last_seen").alias("last"), F.count_if(F.col("rule_id") != "").alias("rules_seen"))
    tot = tot.withColumn("window_days", F.round((F.unix_micros("last") - F.unix_micros("first")) / 86400000000.0, 1))
    return tot, per.where("rule_id != ''").select(*by, "rule_id", "n", "last_seen")


def corroborate(rules: DataFrame, totals: DataFrame, per_rule: DataFrame, quiet_days: int = 90) -> DataFrame:
    """L3: counters against logs. A rule is looked up by id, and by name where its id was not logged."""
    by = [c for c in totals.columns if c == "device_id"]
    a = per_rule.select(*by, F.col("rule_id").alias("id"), F.col("n").alias("n1"), F.col("last_seen").alias("l1"))
    r = rules.where("enabled").withColumn("rule", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("id")))
    b = per_rule.select(*by, F.col("rule_id").alias("rule"), F.col("n").alias("n2"), F.col("last_seen").alias("l2"))
    j = r.join(a, [*by, "id"], "left").join(b, [*by, "rule"], "left")
    end = totals.select(*by, F.col("last").alias("log_end"))
    j = j.join(end, by, "left") if by else j.withColumn("log_end", end.select("log_end").scalar())
    seen = F.coalesce(F.nullif(F.coalesce("n1", F.lit(0)), F.lit(0)), F.col("n2"), F.lit(0))
    last = F.coalesce("l1", "l2")
    quiet = F.floor((F.unix_micros("log_end") - F.unix_micros(last)) / 86400000000)
    v = (F.when((F.col("hit_count") == 0) & (seen == 0), "confirmed_unused").when((F.col("hit_count") == 0) & (seen > 0), "counter_was_reset")
         .when((F.col("hit_count") > 0) & (seen == 0), "unlogged").when(last.isNotNull() & (quiet > quiet_days), "quiet"))
    return j.withColumn("verdict", v).where("verdict is not null").select(*[c for c in ("device_id",) if c in j.columns], F.col("id").alias("rule_id"), "rule", "verdict", "hit_count", seen.alias("log_events"), last.alias("last_seen"))
