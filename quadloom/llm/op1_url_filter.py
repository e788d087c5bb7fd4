"""URL rules by Bloom filter cascades: exact membership without joins.

Level 0 of a cascade holds the listed keys, level 1 the keys of the universe that level 0
wrongly accepts, level 2 the listed keys that level 1 wrongly accepts, and so on until a
level is empty.  A key of the universe is listed when the first level that rejects it has an
odd number (or, past the last level, when the number of levels is odd).  Because the universe
is complete, the answer is exact, and one expression over bit words decides it.

The filters are literals of a plan.  Their size follows the list, not the corpus: the first
level's false positive rate is chosen so that about as many wrong keys as listed ones remain.
A list whose filter would pass ``max_words`` is answered by a semi join on the key instead,
with the same result.

Edge cases: a NULL url or one without ``://`` has an empty host and path, matches nothing and
is allowed; empty tables give no rows; repeated rows are judged one by one; other columns are
left out of the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

MAX_WORDS = 1 << 19


def _positions(key: Column, words: int, hashes: int, level: int) -> list[Column]:
    """Bit positions of a key at a level: one 64-bit hash per position."""
    return [F.pmod(F.xxhash64(F.lit(f"{level}:{i}"), key), F.lit(words * 64)) for i in range(hashes)]


@dataclass
class Level:
    number: int
    hashes: int
    bits: list[int]

    def accepts(self, key: Column) -> Column:
        # The split and the cast are folded into one constant array by the optimizer.
        table = F.split(F.lit(",".join(map(str, self.bits))), ",").cast("array<bigint>")
        hit = F.lit(True)
        for p in _positions(key, len(self.bits), self.hashes, self.number):
            word = F.get(table, F.shiftright(p, 6).cast("int"))
            hit = hit & (F.call_function("bit_get", word, (p % 64).cast("int")) == 1)
        return hit


@dataclass
class Cascade:
    """Exact set membership for keys of the universe it was built on."""

    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.accepts(key), out).otherwise(F.lit(level.number % 2 == 1))
        return F.coalesce(out, F.lit(False))


def _level(keys: DataFrame, n: int, number: int, rate: float, max_words: int) -> Level | None:
    hashes = max(1, round(-math.log2(rate)))
    words = max(1, math.ceil(n * hashes / math.log(2) / 64))
    if words > max_words:
        return None
    at = F.explode(F.array(*_positions(F.col("key"), words, hashes, number)))
    rows = (keys.select(at.alias("p"))
            .groupBy(F.shiftright("p", 6).cast("int").alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS INT)))").alias("b"))
            .collect())  # at most max_words rows
    bits = [0] * words
    for r in rows:
        bits[r.w] = r.b
    return Level(number, hashes, bits)


def build_cascade(universe: DataFrame, max_words: int = MAX_WORDS) -> Cascade | None:
    """A cascade over ``universe(key, listed)``, keys distinct; None if it would grow past
    ``max_words`` 64-bit words in one level."""
    n = {r.listed: r.n for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    listed, other = n.get(True, 0), n.get(False, 0)
    cascade, current, size, of = Cascade(), universe, listed, True
    while size:
        number = len(cascade.levels)
        rate = min(0.5, max(listed, 1) / (other + 1)) if number == 0 else 0.5
        level = _level(current.where(F.col("listed") == of), size, number, rate, max_words)
        if level is None:
            return None
        cascade.levels.append(level)
        of = not of
        # what the levels so far accept decides which keys the next one must hold
        current = current.where((F.col("listed") != of) | level.accepts(F.col("key")))
        size = current.where(F.col("listed") == of).count()
    return cascade


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _candidates(depth: int, lengths: list[int]) -> Column:
    """Rule keys that could fit a host and a path: every parent domain up to ``depth`` labels
    and the host itself is covered by the deepest listed key, every listed path length."""
    paths = [F.substring("path", 1, n) for n in lengths]
    hosts = [F.substring_index("host", ".", -i) for i in range(1, depth + 1)]
    return F.array_distinct(F.filter(
        F.array(*[F.when((F.length(p) == n) & (F.col("host") != ""), F.concat(h, p))
                  for p, n in zip(paths, lengths) for h in hosts]), lambda k: k.isNotNull()))


def _members(urls: DataFrame, key_array: Column, listed: DataFrame, name: str,
             max_words: int) -> DataFrame:
    """Adds ``name``: the keys of ``key_array`` that are in ``listed(key)``."""
    every = urls.select(F.explode(key_array).alias("key")).groupBy("key").agg(F.lit(0).alias("x"))
    marked = listed.select("key", F.lit(True).alias("l")).distinct()
    universe = materialise(
        every.join(marked, "key", "left").select("key", F.coalesce("l", F.lit(False)).alias("listed")),
        "universe")
    cascade = build_cascade(universe, max_words)
    if cascade is not None:
        return urls.withColumn(name, F.filter(key_array, cascade.contains))
    if "row" not in urls.columns:  # the join form needs a name for each row, fixed between reads
        urls = materialise(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    hits = (urls.select("row", F.explode(key_array).alias("key"))
            .join(universe.where("listed"), "key", "left_semi")
            .groupBy("row").agg(F.collect_set("key").alias(name)))  # a row's own keys only
    return urls.join(hits, "row", "left").withColumn(
        name, F.coalesce(name, F.array().cast("array<string>")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: DataFrame,
               max_words: int | None = None) -> DataFrame:
    """Verdict for every row of ``pages(page_id, url)``.

    ``rules`` are (allow|block, host, path); the longest that fits wins and its text is in
    ``rule``.  Where none fits, a url is blocked when its host or a parent domain is in
    ``blocked_hosts(host)``.  Returns page_id, host, path, rule, verdict, listed_host.
    """
    spark = pages.sparkSession
    max_words = MAX_WORDS if max_words is None else max_words
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    depth = max([r[1].count(".") + 1 for r in rules], default=1)
    lengths = sorted({len(r[2]) for r in rules})
    found = urls
    for kind in ("allow", "block"):
        keys = [(h + p,) for k, h, p in rules if k == kind]
        found = _members(found, _candidates(depth, lengths) if lengths else F.array().cast("array<string>"),
                         spark.createDataFrame(keys, "key string"), kind, max_words)
    hosts = blocked_hosts.select(F.col("host").alias("key")).where("key <> ''")
    deepest = hosts.agg(F.max(F.size(F.split("key", r"\."))).alias("d")).first().d or 1
    found = _members(found, _candidates(deepest, [0]), hosts, "listed", max_words)
    longest = F.array_sort(F.transform(
        F.concat("allow", "block"), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    rule = F.get(longest, F.lit(0))["k"]
    listed = F.size("listed") > 0
    return found.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.when(rule.isNotNull(), F.when(F.array_contains("block", rule), "block").otherwise("allow"))
        .otherwise(F.when(listed, "block").otherwise("allow")).alias("verdict"),
        listed.alias("listed_host"))
