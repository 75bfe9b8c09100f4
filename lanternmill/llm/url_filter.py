"""URL filters: prefix rules, then exact membership in a list by a cascade of Bloom filters.

The universe is every distinct key (host and path) of the corpus. Level 1 encodes the listed keys; level 2 the other
keys that pass level 1 by mistake; level 3 the listed keys that pass level 2; and so on until nothing passes by
mistake. A key is listed if the first level that it fails is even. So a row is judged by bit tests against a few arrays
that the plan holds as constants: no join, and for keys of the universe no error. All of it is SQL expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternmill.llm import scratch

#: (host, path, verdict); the longest rule that fits wins.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Bits of the largest level that a plan holds; larger universes are judged in segments of the hash.
MAX_BITS = 1 << 26
#: Keys in 1000 that pass the first level, and later levels, by mistake.
FIRST_RATE, LATER_RATE = 0.05, 0.25


def _after(url: Column) -> Column:
    """What follows the first ://, null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(the longest rule that fits columns host and path, its verdict); null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


class Level:
    """One Bloom filter: its number of bits and hashes, and the table of one row that holds its words.

    It never has over MAX_BITS bits; with more members than that serves, more keys pass by mistake.
    """

    def __init__(self, members: DataFrame, count: int, rate: float, seed: int):
        self.bits = max(64, min(MAX_BITS, 64 * math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64)))
        self.hashes, self.seed = max(1, round(self.bits / max(count, 1) * math.log(2))), seed
        set_bits = members.select(F.explode(F.array(*self._places(F.col("key")))).alias("bit"))
        words = set_bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("value"))
        every = words.unionByName(members.sparkSession.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("value")))
        dense = every.groupBy("word").agg(F.bit_or("value").alias("value"))
        # one row of at most MAX_BITS bits
        self.table = scratch.saved(dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "value"))), lambda x: x["value"]).alias("words")), "bloom")

    def _places(self, key: Column) -> list[Column]:
        one, two = F.xxhash64(key, F.lit(self.seed)), F.xxhash64(F.lit(self.seed), key)
        one, two = F.pmod(one, F.lit(self.bits)), F.pmod(two, F.lit(self.bits))  # so that no sum overflows
        return [F.pmod(one + two * k, F.lit(self.bits)) for k in range(self.hashes)]

    def passes(self, key: Column | None = None) -> Column:
        """Whether a key (column key if none is given) passes."""
        words = self.table.scalar()
        tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1 for p in self._places(F.col("key") if key is None else key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Cascade:
    """`listed()` tells whether column key is in the list, exactly for every key of the universe."""

    def __init__(self, universe: DataFrame, seed: int = 1, first_rate: float = FIRST_RATE, later_rate: float = LATER_RATE):
        """universe: distinct keys and a boolean `listed`."""
        inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
        self.levels: list[Level] = []
        count = inside.count()
        while count:
            rate = first_rate if not self.levels else later_rate
            self.levels.append(Level(inside, count, rate, seed + len(self.levels)))
            wrong = scratch.saved(outside.where(self.levels[-1].passes()), "mistaken")
            inside, outside, count = wrong, inside, wrong.count()

    def listed(self) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k, level in reversed(list(enumerate(self.levels))):
            out = F.when(level.passes(), out).otherwise(F.lit(k % 2 == 1))
        return out


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; listed: a column `key` of host || path values to block.

    A null url, or one without ://, has an empty host and path and so the key ''. Null keys of the list don't count,
    repeated ones count once, and keys that no page has only cost space in nothing: the universe holds the corpus's
    keys alone. Repeated rows are judged each; extra columns are not read. If a level would take over max_bits, keys are
    dealt by hash to segments with a cascade each; the pages are still read once, each row tested by its own segment's.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("key", F.concat("host", "path"))
    keys = rows.select("key", F.lit(False).alias("listed"), F.lit(True).alias("seen")).unionByName(listed.where("key is not null").select("key", F.lit(True).alias("listed"), F.lit(False).alias("seen")))
    universe = keys.groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_or("seen").alias("seen")).where("seen").drop("seen")
    universe = scratch.saved(universe, "universe")
    sizes = universe.agg(F.count_if("listed").alias("inside"), F.count("*").alias("all")).first()
    bits = lambda n, rate: n * -math.log(rate) / math.log(2) ** 2
    segments = max(1, math.ceil(max(bits(sizes.inside, FIRST_RATE), bits(sizes.all * FIRST_RATE, LATER_RATE) if sizes.inside else 0) / max_bits))
    text, verdict = rule(rules)
    segment = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(segments))
    listed = Cascade(universe).listed() if segments == 1 else F.lit(False)
    for s in range(segments if segments > 1 else 0):
        listed = F.when(segment == s, Cascade(universe.where(segment == s)).listed()).otherwise(listed)
    return rows.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(listed, "block").otherwise("allow")).alias("verdict"))


def referred(pages: DataFrame) -> DataFrame:
    """The list that the query blocks: host and path of every url whose query names a referrer (ref=)."""
    return pages.where(F.col("url").rlike(r"[?&]ref=")).select(F.concat(host(F.col("url")), path(F.col("url"))).alias("key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, referred(pages))


SQL = """
WITH u AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
k AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
listed AS (SELECT DISTINCT host || path AS key FROM k WHERE regexp_matches(url, '[?&]ref=')),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT page_id, h || p AS rule, v FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1)
SELECT k.page_id, host, path, rule, coalesce(v, CASE WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM k LEFT JOIN fit USING (page_id)
"""
