"""URL filter: path rules, then exact membership in a block list by a Bloom filter cascade.

The cascade's first level holds the listed keys, its second those other keys of the corpus that
the first lets through by mistake, its third the listed keys that pass the second by mistake, and
so on until a level makes no mistake. For every key of the corpus, the first level that lacks it
tells whether it is listed: no lookup joins, and no verdict is a guess.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import table
from quillgraph.llm.text_sql import ascii_lower
from quillgraph.operators.components import checkpoint

#: (verdict, host, path) of the path rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Hosts that are blocked with all their subdomains.
LISTED = ["ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org"]
#: A level is a constant of the plan: this many bits (1 MB) or about as many. A list that needs more is parted by hash, each part with a cascade of its own.
MOST_BITS = 8_388_608
#: Parts whose cascades are in one plan; more take more passes over the pages.
TOGETHER = 4
MOST_HASHES, BITS_A_KEY = 10, 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: on to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def _suffixes(host: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def bits_a_key(keys: int, others: int) -> int:
    """So many bits for each key that about as many others pass by mistake as there are keys."""
    return max(BITS_A_KEY, math.ceil(1.6 * math.log2(max(2, others / max(1, keys)))))


class Level:
    """A Bloom filter: bit positions are hashes of (level, k, key). others: how many keys it is asked about besides its own."""

    def __init__(self, keys: DataFrame, level: int, others: int) -> None:
        self.level, n = level, keys.count()
        each = bits_a_key(n, others)
        self.bits, self.hashes = 64 * math.ceil(max(1, n) * each / 64), min(MOST_HASHES, round(each * math.log(2)))
        at = F.explode(F.array(*[self._position(F.col("key"), k) for k in range(self.hashes)])).alias("at")
        words = keys.select(at).groupBy(F.expr("at div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("m"))
        found = {r["w"]: r["m"] for r in words.collect()}
        # as text, which the optimizer turns into one constant
        self.words = F.split(F.lit(" ".join(str(found.get(w, 0)) for w in range(self.bits // 64))), " ").cast("array<bigint>")

    def _position(self, key: Column, k: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.level), F.lit(k), key), F.lit(self.bits))

    def has(self, key: Column) -> Column:
        at = F.array(*[self._position(key, k) for k in range(self.hashes)])
        bit = lambda x: F.getbit(F.get(self.words, F.shiftright(x, 6).cast("int")), F.pmod(x, F.lit(64)).cast("int")) == 1
        return F.coalesce(F.forall(at, bit), F.lit(False))


def cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """The levels for keys ``key`` of the corpus and of the list. Both may hold repeated and NULL keys.

    Only while it is built do keys meet the list in a join. The first level is sized by both counts, so that what passes it by
    mistake is about as much as the list however large the corpus.
    """
    listed = checkpoint(listed.select("key").where("key IS NOT NULL").distinct())
    others = checkpoint(universe.select("key").where("key IS NOT NULL").distinct().join(listed, "key", "left_anti"))
    levels, inside, outside = [], listed, others
    while True:
        levels.append(level := Level(inside, len(levels), outside.count()))
        wrong = checkpoint(outside.where(level.has(F.col("key"))))
        if wrong.isEmpty():
            return levels
        inside, outside = wrong, inside


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: exact."""
    out = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        out = F.when(levels[k].has(key), out).otherwise(F.lit(k % 2 == 1))
    return out


def _in_parts(of: dict[int, list[Level]], parts: int) -> Callable[[Column], Column]:
    def test(key: Column) -> Column:
        found = F.lit(False)
        for p, levels in of.items():
            found = F.when(F.pmod(F.hash(key), F.lit(parts)) == p, member(levels, key)).otherwise(found)
        return found

    return test


def judge(pages: DataFrame, listed: list[str] | DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", most: int | None = None) -> DataFrame:
    """``(key, host, path, rule, verdict)`` for every row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest of those that fit
    gives the verdict. Without one, a page is blocked if its host or a domain above it is listed.
    NULL urls and urls without ``://`` have an empty host and path, fit no rule and are allowed unless
    the empty host is listed. Keys may be NULL or repeat; other columns are not read. Empty input, empty result. Urls may have
    any length. listed: hosts, or rows ``key``; a list beyond ``most`` bits (MOST_BITS) goes through as many cascades as it needs, a few in each pass.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    universe = rows.select("host").distinct().select(F.explode(_suffixes(F.col("host"))).alias("key"))
    if isinstance(listed, DataFrame):
        keys = checkpoint(listed.select("key").where("key IS NOT NULL").distinct())
    else:
        keys = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, listed)).cast("array<string>")).alias("key"))
    n, others = (keys.count(), universe.count()) if isinstance(listed, DataFrame) else (len(listed), 0)
    parts = -(-n * bits_a_key(n, others) // (most or MOST_BITS)) or 1
    blocked = F.lit(False)
    if parts == 1:
        levels = cascade(universe, keys)
        blocked = F.exists(_suffixes(F.col("host")), lambda k: member(levels, k))
    else:
        part = F.pmod(F.hash("key"), F.lit(parts))
        universe, keys = (checkpoint(x.withColumn("part", part)) for x in (universe.distinct(), keys))
        rows = rows.withColumn("listed", F.lit(False))
        for first in range(0, parts, TOGETHER):
            of = {p: cascade(universe.where(F.col("part") == p), keys.where(F.col("part") == p)) for p in range(first, min(first + TOGETHER, parts))}
            rows = checkpoint(rows.withColumn("listed", F.col("listed") | F.exists(_suffixes(F.col("host")), _in_parts(of, parts))))
        blocked = F.col("listed")

    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rows.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), LISTED, RULES)


def op8_sql() -> str:
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))]
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    rule = " ".join(f.format(h + p) for f, (_, h, p) in zip(fits, ordered, strict=True))
    says = " ".join(f.format(v) for f, (v, _, _) in zip(fits, ordered, strict=True))
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
       CASE {says} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM p
"""
