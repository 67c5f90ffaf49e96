"""Operator 5: URL rules behind a blocked Bloom filter.

A rule is a listed canonical URL: host (with all its subdomains) and path
prefix, such as ``example.org/es/``.  Every page URL is expanded to the rules
that could fit it: each suffix of its host at a label's edge, with each path
prefix of a length that occurs in the list.  A split-block Bloom filter (blocks
of eight 32-bit words, one bit in each) lets possible hits pass; an exact hash
join with the list removes the false positives; the longest rule wins.

A filter of up to ``MAX_FILTER_WORDS`` words is broadcast as a table of blocks.  A
longer one is probed by a shuffled join on the block, once for each distinct
candidate.  The list itself is broadcast only while it has at most
``MAX_BROADCAST_RULES`` entries; beyond that the few candidates that many pages
share are joined by broadcast and the others by their hash.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and fits no rule; a URL that fits none is allowed; repeated pages all stay; an
empty table or an empty list is fine; extra columns are ignored.  Of equally
long fitting rules ``block`` wins, then the smaller rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.util import ascii_lower, columns, materialize
from tessera.operators.components import HOT, join_hot

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

WORDS = 8
MAX_FILTER_WORDS = 1 << 20
MAX_BROADCAST_RULES = 50_000


def rules_frame(spark, rules=RULES) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules])
    return spark.range(1).select(F.inline(pairs))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract has them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    plain = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(plain, "/", 1)
    return ascii_lower(host), F.substring(plain, F.length(host) + 1, F.length(plain))


def block_and_bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block, and its bit in each of the block's words."""
    h = F.xxhash64(key, F.lit(1))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [F.call_function(
        "shiftleft",
        F.lit(1).cast("long"),
        F.shiftrightunsigned(h, 5 * w).bitwiseAND(F.lit(31)).cast("int"),
    ) for w in range(WORDS)]


def build_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, words): one row per block in use."""
    block, bits = block_and_bits(F.col("rule"), blocks)
    rows = rules.select(block.alias("block"), *[b.alias(f"b{w}") for w, b in enumerate(bits)])
    return rows.groupBy("block").agg(F.array(*[F.bit_or(f"b{w}") for w in range(WORDS)]).alias("words"))


def hit(words: Column, bits: list[Column]) -> Column:
    out = F.lit(True)
    for w, bit in enumerate(bits):
        out = out & (words[w].bitwiseAND(bit) != 0)
    return out


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """The rules that could fit, as strings."""
    labels = F.split(host, r"\.", -1)
    count = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count), "."))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths] or [F.lit(None).cast("string")])
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def filter_urls(pages: DataFrame, rules: DataFrame, bits_per_rule: int = 16, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    spark = pages.sparkSession
    rules = columns(rules, rule="string", verdict="string").where(F.instr("rule", "/") > 0)
    rules = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    shape = rules.agg(F.count("*").alias("n"), F.collect_set(F.length(F.col("rule")) - F.instr("rule", "/") + 1).alias("lengths")).first()
    n, lengths = shape["n"], sorted(shape["lengths"])
    blocks = max(1, -(-n * bits_per_rule // (32 * WORDS)))

    host, path = split_url(F.col("url"))
    rows = columns(pages, page_id="long", url="string").select(F.monotonically_increasing_id().alias("_row"), "page_id", host.alias("host"), path.alias("path"))
    possible = candidates(F.col("host"), F.col("path"), lengths)
    listed = rules.select(F.col("rule").alias("key"), "rule", "verdict")
    exploded = rows.select("*", F.explode_outer(possible).alias("key"))
    block, bits = block_and_bits(F.col("key"), blocks)
    table = build_filter(rules, blocks)
    if blocks * WORDS <= MAX_FILTER_WORDS:
        passed = F.when(hit(F.col("words"), bits), F.col("key")).alias("key")
        found = exploded.withColumn("block", block).join(F.broadcast(table), "block", "left").select("_row", "page_id", "host", "path", passed)
    else:
        found = materialize(exploded, "candidates")
        probed = found.select("key").distinct().withColumn("block", block).join(table, "block")
        listed = materialize(probed.where(hit(F.col("words"), bits)).select("key").join(listed, "key"), "listed")  # exact from here
    if n <= MAX_BROADCAST_RULES:
        joined = found.join(F.broadcast(listed), "key", "left")
    else:
        found = materialize(found.distinct(), "possible")  # candidates that the filter stopped are one row a page
        often = found.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(1.0, found.count() * HOT))
        some = join_hot(found.where("key IS NOT NULL"), listed, "key", often, "left")
        joined = some.unionByName(found.where("key IS NULL").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string")))
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("size"), F.col("verdict").alias("verdict"), F.col("rule").alias("rule"))))
    judged = joined.groupBy("_row", "page_id", "host", "path").agg(best.alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
