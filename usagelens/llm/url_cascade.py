"""URL rules by a Bloom filter cascade (operator 2): DataFrame functions only.

Every rule is a key ``host + path``. A url's candidate keys are its host's suffixes joined with its path's
prefixes, in the shapes (labels, path length) that occur among the rules. Level 1 of a cascade encodes the listed
keys, level 2 the keys of the corpus that level 1 takes for listed, level 3 the listed keys that level 2 takes, and
so on until a level takes none wrongly: over the complete key universe the cascade's answer is exact, and a url is
judged from its own row alone, without a join.
"""

from __future__ import annotations

import base64
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize

#: Bits of one level that may travel with the plan: 8 MB.
MOST_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def _spots(key: Column, bits: int, hashes: int, level: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level * 1000 + i)), F.lit(bits)) for i in range(hashes)])


class Level:
    """One Bloom filter as a binary literal, at most MOST_BITS bits."""

    def __init__(self, keys: DataFrame, n: int, rate: float, level: int):
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(n * self.hashes / math.log(2)))
        self.level = level
        if self.bits > MOST_BITS:
            raise ValueError(f"{n} keys need {self.bits} bits; split the list by host and apply a cascade to each part")
        rows = (
            keys.select(F.explode(_spots(F.col("key"), self.bits, self.hashes, level)).alias("at"))
            .groupBy(F.expr("at div 8").alias("byte"))
            .agg(F.bit_or(F.expr("shiftleft(1, cast(at % 8 as int))")).alias("set"))
            .collect()  # at most bits / 8 rows
        )
        filled = np.zeros(self.bits // 8 + 1, np.uint8)
        for byte, bit in rows:
            filled[byte] = bit
        self.literal = F.unbase64(F.lit(base64.b64encode(filled.tobytes()).decode()))

    def takes(self, key: Column) -> Column:
        held = None
        for i in range(self.hashes):
            at = F.pmod(F.xxhash64(key, F.lit(self.level * 1000 + i)), F.lit(self.bits))
            byte = F.conv(F.hex(F.substring(self.literal, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            bit = F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1
            held = bit if held is None else held & bit
        return held


class Cascade:
    """Exact membership of ``listed`` (a column key) among the keys of ``universe`` (a column key) and of listed itself.

    listed may hold repeated keys; null keys are never members. An empty list has no members.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = listed.select("key").where("key is not null").distinct()
        inside = universe.select("key").where("key is not null")
        self.levels: list[Level] = []
        n, total = listed.count(), inside.agg(F.approx_count_distinct("key")).first()[0]
        rate = min(0.5, math.sqrt(0.5) * n / max(1, total))
        keys, others = listed, None
        while n:
            self.levels.append(Level(keys, n, rate, len(self.levels) + 1))
            last, rate = self.levels[-1], 0.5
            if others is None:  # unlisted keys that level 1 takes: keys of the universe without a listed twin
                both = inside.where(last.takes(F.col("key"))).select("key", F.lit(0).alias("is")).unionByName(listed.select("key", F.lit(1).alias("is")))
                wrong = both.groupBy("key").agg(F.max("is").alias("is")).where("is = 0").select("key")
            else:
                wrong = others.where(last.takes(F.col("key")))
            wrong = materialize(wrong, "cascade")
            keys, others, n = wrong, keys, wrong.count()

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(self.levels[i - 1].takes(key), out).otherwise(F.lit(i % 2 == 0))
        return F.coalesce(out, F.lit(False))


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict added (columns of those names are replaced).

    rules: columns action (``allow`` or ``block``) and rule (``host/path``). A rule fits its host and all
    subdomains where the url's path starts with the rule's path; the longest fitting rule decides, of equally long ones
    that with the longer host; a rule listed under both actions blocks. Where none fits, the url isn't on the
    list and the verdict is ``allow``. A null url, or one without ``://``, has an empty host and path. Repeated rows
    stay; an empty table gives an empty result.
    """
    spark: SparkSession = pages.sparkSession
    rules = rules.select("action", F.col("rule").alias("key")).where("action is not null and instr(rule, '/') > 0").distinct()
    host = F.substring_index("key", "/", 1)
    shapes = [(r[0], r[1]) for r in rules.select(F.size(F.split(host, r"\.")), F.length("key") - F.length(host)).distinct().limit(10_001).collect()]
    if len(shapes) > 10_000:
        raise ValueError("more than 10,000 shapes (host labels, path length) of rules")
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    dots = F.length("host") - F.length(F.translate("host", ".", ""))
    keys = [
        F.when((dots >= labels - 1) & (F.length("path") >= size), F.concat(F.substring_index("host", ".", -labels), F.substring(F.col("path"), 1, size)))
        for labels, size in sorted(shapes)
    ]
    if not keys:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    candidates = F.array_compact(F.array(*keys))
    universe = judged.select(F.explode(F.array_distinct(candidates)).alias("key"))
    block = Cascade(rules.where("action = 'block'"), universe)
    allow = Cascade(rules.where("action = 'allow'"), universe)
    fits = F.filter(candidates, lambda k: block.has(k) | allow.has(k))
    best = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("size"), F.length(F.substring_index(k, "/", 1)).alias("host_size"), k.alias("key"))))
    out = judged.withColumn("rule", best["key"])
    return out.withColumn("verdict", F.when(F.col("rule").isNotNull() & block.has(F.col("rule")), F.lit("block")).otherwise(F.lit("allow")))


#: The rules of query op2.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "action string, rule string")
    return url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(action, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
m AS (
  SELECT u.*, (SELECT max_by(rule, length(rule)) FROM r WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)) AS rule
  FROM u)
SELECT page_id, host, path, rule, coalesce((SELECT max(action) FROM r WHERE r.rule = m.rule), 'allow') AS verdict FROM m
"""
