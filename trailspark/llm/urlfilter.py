"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each URL is expanded into the expressions that a rule could be written as: suffixes of its
host at label borders, with as many labels as some rule has, times prefixes of its path.
Host suffixes meet the rules' hosts first, so a path is only cut at lengths that rules of
these very hosts have, however many lengths the whole table knows. An expression meets the
rules by the first eight hex digits of its SHA-256; the whole digest is then compared, and the
longest rule decides. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PREFIX_DIGITS = 8
#: Rules are broadcast up to this many; beyond, both sides are shuffled and the rules copied ``SALTS`` times.
MAX_BROADCAST = 200_000
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def split_url(url):
    """Host (ASCII letters lower-cased) and path of a URL column; both empty where it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return host, path


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule`` (host and path of the longest fitting rule, or null) and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equal
    rules with different verdicts ``block`` holds; of equally long ones the longer host's.
    Rules with a null are ignored; without rules every verdict is ``otherwise``. Repeated
    rows are judged each; other columns aren't carried.
    """
    known = rules.where("host is not null and path is not null and verdict is not null")
    known = known.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))
    known = known.select("host", "path", "verdict", F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest"), F.concat("host", "path").alias("rule"))
    n, labels = known.agg(F.count("*"), F.collect_set(F.size(F.split("host", r"\.", -1)))).first()
    host, path = split_url(F.col("u"))
    pages = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).select("id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("at"))
    if not n:
        return pages.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    hosts = known.groupBy(F.sha2("host", 256).alias("host_digest")).agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths"))
    known = known.select("digest", "rule", F.col("verdict").alias("says"), F.length("host").alias("host_size"))
    parts = F.split("host", r"\.", -1)
    suffixes = F.filter(F.array(*[F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in sorted(labels)]), lambda x: x.isNotNull())
    asked = pages.select("id", "host", "path", "at", F.explode_outer(suffixes).alias("suffix")).withColumn("asked", F.sha2("suffix", 256))
    asked = _met(asked, hosts, "host_digest", n).drop("asked")
    cuts = F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda k: k <= F.length("path"))
    digests = F.transform(cuts, lambda k: F.sha2(F.concat(F.col("suffix"), F.lit("\n"), F.substring(F.col("path"), F.lit(1), k)), 256))
    met = _met(asked.select("id", "host", "path", "at", F.explode_outer(digests).alias("asked")), known, "digest", n)
    best = met.groupBy("at").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("size"), "host_size", "rule", "says"))).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(otherwise)).alias("verdict"))


def _met(asked: DataFrame, known: DataFrame, digest: str, n: int) -> DataFrame:
    """``asked`` left-joined to ``known`` by the first digits of ``asked`` and ``digest``, the whole of which must then agree."""
    asked = asked.withColumn("short", F.substring("asked", 1, PREFIX_DIGITS))
    known = known.withColumn("known_short", F.substring(digest, 1, PREFIX_DIGITS))
    match = (F.col("short") == F.col("known_short")) & (F.col("asked") == F.col(digest))
    if n <= MAX_BROADCAST:
        return asked.join(F.broadcast(known), match, "left").drop("short", "known_short")
    known = known.withColumn("known_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("at", "asked"), F.lit(SALTS)).cast("int"))
    return asked.join(known, match & (F.col("salt") == F.col("known_salt")), "left").drop("short", "known_short", "salt", "known_salt")
