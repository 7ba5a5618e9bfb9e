"""Shared schemas and the fixed vocabularies of result, observation and severity states."""
from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Typed value of a setting. kind: bool | num | str | list | null | badregex.
# List members are kept in text form ("2", "True"), numbers without a trailing ".0".
TVAL = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("b", T.BooleanType()),
    T.StructField("n", T.DoubleType()),
    T.StructField("s", T.StringType()),
    T.StructField("l", T.ArrayType(T.StringType())),
])
TVAL_DDL = "struct<kind:string,b:boolean,n:double,s:string,l:array<string>>"

EVIDENCE = T.ArrayType(T.StructType([
    T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()),
    T.StructField("raw", T.StringType()), T.StructField("record_id", T.StringType())]))

# The seven result states, in report order.
RESULT_STATES = ["PASS", "FAIL", "PARTIAL", "NOT_APPLICABLE", "MANUAL_REVIEW", "UNKNOWN", "ERROR"]
DECIDED = ["PASS", "FAIL", "PARTIAL"]
# Severity weights.
SEVERITY_WEIGHT = {"critical": 10.0, "high": 6.0, "medium": 3.0, "low": 1.0}
# How bad each state is when several scopes of one setting disagree (0 is worst).
WORST_RANK = {"FAIL": 0, "PARTIAL": 1, "UNKNOWN": 2, "ERROR": 3, "PASS": 4, "NOT_APPLICABLE": 5, "MANUAL_REVIEW": 6}
# Words that mean an action lets traffic through.
ALLOW_WORDS = ["allow", "accept", "permit"]


def lookup(col: Column, table: dict, default=None) -> Column:
    """A small constant table as a CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(col == F.lit(k), F.lit(v)) if out is None else out.when(col == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def text_of(v) -> str:
    """The text form of a list member."""
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def tval_py(v) -> dict | None:
    """A Python value as a TVAL row (for authored controls and small fixtures)."""
    if v is None:
        return None
    out = {"kind": "str", "b": None, "n": None, "s": None, "l": None}
    if isinstance(v, bool):
        out.update(kind="bool", b=v)
    elif isinstance(v, (int, float)):
        out.update(kind="num", n=float(v))
    elif isinstance(v, (list, tuple, set)):
        out.update(kind="list", l=[text_of(x) for x in v])
    else:
        out.update(s=str(v))
    return out


def _tv(kind: str, **parts: Column) -> Column:
    cols = {"b": F.lit(None).cast("boolean"), "n": F.lit(None).cast("double"),
            "s": F.lit(None).cast("string"), "l": F.lit(None).cast("array<string>")}
    cols.update(parts)
    return F.struct(F.lit(kind).alias("kind"), *[cols[c].alias(c) for c in ("b", "n", "s", "l")])


def tv_bool(c: Column) -> Column:
    return F.when(c.isNotNull(), _tv("bool", b=c.cast("boolean")))


def tv_num(c: Column) -> Column:
    return F.when(c.isNotNull(), _tv("num", n=c.cast("double")))


def tv_str(c: Column) -> Column:
    return F.when(c.isNotNull(), _tv("str", s=c.cast("string")))


def tv_list(c: Column) -> Column:
    return F.when(c.isNotNull(), _tv("list", l=c.cast("array<string>")))


def num_text(n: Column) -> Column:
    """A double in the form a list member carries."""
    return F.when(n == F.floor(n), F.format_string("%.0f", n)).otherwise(n.cast("string"))


def small_side(df, limit: int):
    """df marked for broadcast if it has `limit` rows at most, counted now; a larger one is marked for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else shuffled(df)


def spread(df, *cols: str):
    """df dealt by cols over as many tasks as the session shuffles into: rows that are about to grow and come out of few files would be worked on by few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *cols)


def dealt(df, rows: int, *cols: str):
    """df dealt by cols over tasks of about `rows` rows, counted now: what is sorted or folded there holds no more of a larger table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *cols)


def shuffled(df):
    """df as a side of a join that is sent to no task whole: of rows that come out of files or arrays Spark's estimate knows only what they came from."""
    return df.hint("merge")


def bounded(df, limit: int, what: str):
    """df, which is about to be folded into one value; fails loudly when it has outgrown what one value may hold."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.where(F.when(total <= limit, F.lit(True)).otherwise(F.raise_error(F.lit(f"{what}: more than {limit} rows")).cast("boolean")))
