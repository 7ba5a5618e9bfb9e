"""Addresses, services and intervals.

An address value becomes an interval of 128-bit keys written as 32 hex digits, so IPv4 and IPv6
order lexicographically in one column and containment is two comparisons.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tokens meaning everything.
ANY_TOKENS = ["any", "all", "0.0.0.0/0", "::/0", "*"]
ANY_NAMES = ["any", "any-ipv4", "any-ipv6", "all", "0.0.0.0/0", "::/0"]
INTERNET = ["0.0.0.0/0", "::/0"]
V4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def ip_to_long(a: Column) -> Column:
    """Dotted IPv4 to a number; NULL when it is not an address."""
    o = [F.split_part(a, F.lit("."), F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    ok = a.rlike(V4) & (F.greatest(*o) <= 255)
    return F.when(ok, ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3])


def mask_len(mask: Column) -> Column:
    """Prefix length of a dotted mask or a plain number; NULL when the mask is not contiguous."""
    m = ip_to_long(mask)
    inv = F.lit(4294967295) - m
    n = F.bit_count(m)
    dotted = F.when(inv.bitwiseAND(inv + 1) == 0, n)
    return F.coalesce(dotted, F.when(mask.rlike(r"^\d{1,2}$"), F.when(mask.try_cast("int") <= 32, mask.try_cast("int"))))


def block_size(prefix: Column) -> Column:
    return F.expr("1L") * F.pow(F.lit(2.0), F.lit(32) - prefix).cast("bigint")


def net_of(addr: Column, mask: Column) -> Column:
    """(lo, hi, prefixlen) of the subnet an interface sits on; no mask is a single host."""
    a = ip_to_long(addr)
    p = F.when(F.coalesce(mask, F.lit("")) == "", F.lit(32)).otherwise(mask_len(mask))
    size = block_size(p)
    lo = a - a % size
    return F.when(a.isNotNull() & p.isNotNull(), F.struct(lo.alias("lo"), (lo + size - 1).alias("hi"), p.cast("int").alias("prefixlen")))


# An address value is worked out in steps, each a transform over the one before, so no step is written out twice.
_STEPS = [
    # the text, whether it means everything, its address, prefix and range parts
    """struct(trim(x) AS t, lower(trim(x)) IN ('any', 'all', '0.0.0.0/0', '::/0', '*') AS any, split_part(trim(x), '/', 1) AS a,
       if(contains(x, '/'), split_part(trim(x), '/', 2), NULL) AS p, trim(x) RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+-[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' AS rng)""",
    # octets of the address and of a dotted mask, both ends of a range, groups of an IPv6 address
    """struct(x.t, x.any, x.rng, x.p, if(x.a RLIKE '^[0-9]{1,3}([.][0-9]{1,3}){3}$', transform(split(x.a, '[.]'), o -> cast(o AS bigint)), NULL) AS o4,
       if(x.p RLIKE '^[0-9]{1,3}([.][0-9]{1,3}){3}$', transform(split(x.p, '[.]'), o -> cast(o AS bigint)), NULL) AS m4,
       if(x.rng, transform(split(split_part(x.t, '-', 1), '[.]'), o -> try_cast(o AS bigint)), NULL) AS r1, if(x.rng, transform(split(split_part(x.t, '-', 2), '[.]'), o -> try_cast(o AS bigint)), NULL) AS r2,
       if(contains(x.a, ':') AND lower(x.a) RLIKE '^[0-9a-f:]+$', filter(split(split_part(lower(x.a), '::', 1), ':'), g -> g != ''), NULL) AS l6,
       if(contains(x.a, '::'), filter(split(split_part(lower(x.a), '::', 2), ':'), g -> g != ''), cast(array() AS array<string>)) AS e6, contains(x.a, '::') AS dbl)""",
    # numbers and the 32-digit form
    """struct(x.t, x.any, x.rng, if(forall(x.o4, o -> o <= 255), concat('00000000000000000000ffff', lpad(lower(hex(aggregate(x.o4, 0L, (s, o) -> s * 256 + o))), 8, '0')), NULL) AS h4,
       CASE WHEN x.p IS NULL THEN 32 WHEN x.p RLIKE '^[0-9]{1,2}$' AND cast(x.p AS int) <= 32 THEN cast(x.p AS int)
            WHEN forall(x.m4, o -> o <= 255) AND bit_count(aggregate(x.m4, 0L, (s, o) -> s * 256 + o)) = 32 - bit_count(4294967295L - aggregate(x.m4, 0L, (s, o) -> s * 256 + o))
             AND ((4294967295L - aggregate(x.m4, 0L, (s, o) -> s * 256 + o)) & (4294967296L - aggregate(x.m4, 0L, (s, o) -> s * 256 + o))) = 0 THEN cast(bit_count(aggregate(x.m4, 0L, (s, o) -> s * 256 + o)) AS int) END AS p4,
       if(forall(x.r1, o -> o <= 255), concat('00000000000000000000ffff', lpad(lower(hex(aggregate(x.r1, 0L, (s, o) -> s * 256 + o))), 8, '0')), NULL) AS h1,
       if(forall(x.r2, o -> o <= 255), concat('00000000000000000000ffff', lpad(lower(hex(aggregate(x.r2, 0L, (s, o) -> s * 256 + o))), 8, '0')), NULL) AS h2,
       concat(x.l6, array_repeat('0', if(x.dbl, greatest(8 - size(x.l6) - size(x.e6), 0), 0)), x.e6) AS g6,
       CASE WHEN x.p IS NULL THEN 128 WHEN x.p RLIKE '^[0-9]{1,3}$' AND cast(x.p AS int) <= 128 THEN cast(x.p AS int) END AS p6)""",
    """struct(x.t, x.any, x.rng, x.h1, x.h2, coalesce(x.h4, if(size(x.g6) = 8 AND forall(x.g6, g -> g RLIKE '^[0-9a-f]{1,4}$'), array_join(transform(x.g6, g -> lpad(g, 4, '0')), ''), NULL)) AS h,
       if(x.h4 IS NOT NULL, x.p4 + 96, x.p6) AS p)""",
    # both ends of the block: whole digits, then the digit the prefix ends in
    """struct(x.t, x.any, x.rng, x.h1, x.h2, x.h, x.p, cast(x.p DIV 4 AS int) AS n, cast(x.p % 4 AS int) AS r, cast(conv(substr(x.h, cast(x.p DIV 4 AS int) + 1, 1), 16, 10) AS int) AS d, cast(pow(2, 4 - x.p % 4) AS int) AS s)""",
    """struct(x.t, x.any, x.rng,
       CASE WHEN x.rng THEN if(x.h2 IS NULL, NULL, x.h1) WHEN x.h IS NOT NULL AND x.p IS NOT NULL THEN concat(substr(x.h, 1, x.n), if(x.r > 0, lower(hex(x.d - x.d % x.s)), ''), repeat('0', 32 - x.n - if(x.r > 0, 1, 0))) END AS lo,
       CASE WHEN x.rng THEN if(x.h1 IS NULL, NULL, x.h2) WHEN x.h IS NOT NULL AND x.p IS NOT NULL THEN concat(substr(x.h, 1, x.n), if(x.r > 0, lower(hex(x.d - x.d % x.s + x.s - 1)), ''), repeat('f', 32 - x.n - if(x.r > 0, 1, 0))) END AS hi)""",
    """struct(x.t, x.any, x.rng, x.lo, x.hi, CASE WHEN x.lo = x.hi THEN 32 WHEN x.lo IS NOT NULL THEN aggregate(sequence(1, 32), 0, (a, i) -> if(a = i - 1 AND substr(x.lo, i, 1) = substr(x.hi, i, 1), i, a)) END AS n)""",
    # index entry: everything, the smallest enclosing block of whole hex digits, or the text itself
    """struct(x.t, x.any, x.rng, x.lo, x.hi, CASE WHEN x.any THEN '*' WHEN x.lo IS NOT NULL THEN concat('b', x.n) ELSE '=' END AS m,
       CASE WHEN x.any THEN '*' WHEN x.lo IS NOT NULL THEN substr(x.lo, 1, x.n) ELSE x.t END AS k)""",
]


def intervals_sql(array: str) -> str:
    for step in _STEPS:
        array = f"transform({array}, x -> {step})"
    return array


def intervals(array: str) -> Column:
    """An array of address values as structs: t (text), any, lo, hi (32-digit keys, NULL for a name), m and k (index entry)."""
    return F.expr(intervals_sql(array))


def interval(value: str) -> Column:
    """The same for one column."""
    return F.expr(f"element_at({intervals_sql(f'array({value})')}, 1)")


def covers(v: str, c: str) -> str:
    """P18 over two interval structs: the rule side any matches; a question about any is matched only by that; else containment."""
    return (f"({v}.any OR (NOT {c}.any AND ({v}.t = {c}.t OR coalesce({v}.lo <= {c}.lo AND {c}.hi <= {v}.hi AND NOT {c}.rng AND NOT ({v}.rng AND contains({c}.t, '/')), false))))")


def addr_in(value: str, candidate: str) -> Column:
    """Is the candidate address or network inside the rule's value?"""
    both = f"arrays_zip({intervals_sql(f'array({value})')}, {intervals_sql(f'array({candidate})')})"
    return F.expr(f"element_at(transform({both}, z -> {covers('z.`0`', 'z.`1`')}), 1)")


def is_any(v: Column) -> Column:
    return F.lower(F.trim(v)).isin(ANY_TOKENS)


def service(value: Column) -> Column:
    """(proto, lo, hi) of a `proto/port[-port]` service; NULL for a name."""
    v = F.lower(F.trim(value))
    rx = r"^(tcp|udp|icmp|icmpv6)/(\d+)(?:-(\d+))?$"
    lo = F.regexp_extract(v, rx, 2).try_cast("int")
    hi = F.coalesce(F.nullif(F.regexp_extract(v, rx, 3), F.lit("")).try_cast("int"), lo)
    return F.when(v.rlike(rx), F.struct(F.regexp_extract(v, rx, 1).alias("proto"), lo.alias("lo"), hi.alias("hi")))


def svc_matches(value: Column, proto: Column, port: Column) -> Column:
    """Any matches; no port asked means the protocol prefix decides; else the port range."""
    s = service(value)
    return (F.when(is_any(value), F.lit(True)).when(port.isNull(), F.lower(F.trim(value)).startswith(F.lower(proto)))
            .otherwise(F.coalesce((s["proto"] == F.lower(proto)) & port.between(s["lo"], s["hi"]), F.lit(False))))


# IPv4 blocks that are not globally reachable (lo, hi).
_PRIVATE = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
            ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
            ("203.0.113.0", 24), ("240.0.0.0", 4)]


def is_global(addr: Column) -> Column:
    """A public IPv4 address (the prefix, if any, is ignored)."""
    n = ip_to_long(F.split_part(addr, F.lit("/"), F.lit(1)))
    private = F.lit(False)
    for a, p in _PRIVATE:
        o = [int(x) for x in a.split(".")]
        lo = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
        private = private | n.between(lo, lo + 2 ** (32 - p) - 1)
    return F.coalesce(n.isNotNull() & ~private, F.lit(False))
