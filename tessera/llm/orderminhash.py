"""Operator 1: Order MinHash fingerprints, with DataFrame functions only.

A text is read as tokens and its k-mers of ``k`` tokens.  A token is a word of up to
``token`` characters; longer runs without white space are cut after a vowel, a
low digit or a mark until ``token`` characters are left, so that a character put in
moves no cut but the next ones; an ideograph is a token of its own.  Equal k-mers are told apart by their
occurrence number.  Coordinate j of the fingerprint takes, under its own order
of the numbered k-mers, the ``ELEMENTS`` = 2 least ones, puts them back into
text order and hashes that tuple: moving a passage changes the fingerprint,
unlike a plain MinHash.  Likeness is the share of equal coordinates.

The order of coordinate j is one hash of the numbered k-mer, turned by j/m of
its range; so one sorted array serves all coordinates, each by a binary search.
Coordinates of a text with few k-mers then depend on each other: the README states
the error against independent orders.  Entries hold 33 bits of a hash above 30 bits
of position, more tokens than a string can have.
Everything about a text happens in its own row; the one shuffle brings
neighbours together: rows are dealt into buckets of ``doc_id`` ranges, and the
first row of each bucket also goes to the bucket before it.

Defined cases: a null text counts as empty; texts of fewer than ``k`` tokens
are one k-mer; an empty text, or one of white space alone, has the fingerprint
of no k-mers; null ids sort first, rows that share an id by text; after the
last row comes the first one (a table of one row is its own neighbour); extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.util import columns

ELEMENTS = 2  # of a tuple; the code puts two in order
#: A packed entry: 33 bits of hash above 30 bits of position.
POSITION = (1 << 30) - 1
IDEOGRAPHS = r"\x{2E80}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
RANGE = 1 << 63
LONG_MIN = -(1 << 63)


def token_pattern(token: int) -> str:
    letter = rf"[^\s{IDEOGRAPHS}]"
    cut = r"[aeiouyAEIOUY0-4\p{P}]"
    return rf"[!-~]{{1,{token}}}+(?!\S)|{letter}{{1,{token}}}+(?!\S)|[{IDEOGRAPHS}]|{letter}{{3,{token + 3}}}?(?<={cut})|{letter}{{1,{token + 4}}}"


def fingerprint_columns(df: DataFrame, text: str, out: str, k: int = 3, m: int = 64, token: int = 12) -> DataFrame:
    """Adds the fingerprint of ``text`` as ``out`` (hex, eight digits a coordinate).

    Each step is a projection of its own: an array that the next step reads more
    than once is then made once.
    """
    t, h, s, v, c = (f"_{out}_{x}" for x in "thsvc")
    df = df.withColumn(t, F.regexp_extract_all(F.col(text), F.lit(token_pattern(token)), F.lit(0)))
    df = df.withColumn(h, F.transform(F.col(t), lambda x: F.xxhash64(x)))
    count = F.greatest(F.size(h) - (k - 1), F.least(F.size(h), F.lit(1)))
    high = F.lit(~POSITION & (RANGE - 1))

    def kmer(x: Column, i: Column) -> Column:
        value = F.xxhash64(x, *[F.get(F.col(h), i + n) for n in range(1, k)])
        return value.bitwiseAND(high).bitwiseOR(F.least(i, F.lit(POSITION)).cast("long"))

    df = df.withColumn(s, F.sort_array(F.transform(F.slice(F.col(h), F.lit(1), count), kmer)))

    def first_at_least(values: Column, bound: Column) -> Column:
        """How many sorted values are less than the bound: a binary search."""
        size = F.size(values)
        steps = F.sequence(F.lit(1), F.ceil(F.log2(size + 1.0)).cast("int") + 1)
        zero = F.struct(F.lit(0).alias("a"), size.alias("b"))

        def halve(at: Column, _: Column) -> Column:
            mid = F.shiftright(at["a"] + at["b"], 1)
            less = (at["a"] < at["b"]) & (F.get(values, mid) < bound)
            return F.struct(F.when(less, mid + 1).otherwise(at["a"]).alias("a"), F.when(less, at["b"]).otherwise(F.greatest(mid, at["a"])).alias("b"))

        return F.aggregate(steps, zero, halve, lambda at: at["a"])

    def numbered(x: Column, i: Column) -> Column:
        mine = x.bitwiseAND(high)
        again = (i > 0) & (F.coalesce(F.get(F.col(s), i - 1), F.lit(-1)).bitwiseAND(high) == mine)
        occurrence = i - first_at_least(F.col(s), mine)
        return F.when(again, F.xxhash64(mine, occurrence).bitwiseAND(high).bitwiseOR(x.bitwiseAND(F.lit(POSITION)))).otherwise(x)

    # Only repeated k-mers move, so the second sort finds the array nearly in order.
    df = df.withColumn(v, F.sort_array(F.transform(F.col(s), numbered)))
    size = F.size(v)

    # Where each coordinate begins, once: the next step reads it several times.
    df = df.withColumn(c, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: first_at_least(F.col(v), j.cast("long") * F.lit(RANGE // m))))

    def coordinate(at: Column) -> Column:
        one, two = (F.get(F.col(v), F.pmod(at + e, size)) for e in range(ELEMENTS))
        later = one.bitwiseAND(F.lit(POSITION)) > two.bitwiseAND(F.lit(POSITION))
        pair = F.xxhash64(F.when(later, two).otherwise(one).bitwiseAND(high), F.when(later, one).otherwise(two).bitwiseAND(high))
        return F.substring(F.hex(pair.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))), 2, 8)

    whole = F.lower(F.array_join(F.transform(c, coordinate), ""))
    df = df.withColumn(out, F.when(size > 0, whole).otherwise(F.lit("-" * 8 * m)))
    return df.drop(t, h, s, v, c)


def likeness(a: Column, b: Column, m: int = 64) -> Column:
    """Share of equal coordinates of two fingerprints."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), F.lit(0), lambda n, j: n + (F.substring(a, j * 8 + 1, 8) == F.substring(b, j * 8 + 1, 8)).cast("int"))
    return same / F.lit(float(m))


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """First keys of the buckets: quantiles of the key, the least key first; at most ``buckets``."""
    at = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.min(key).alias("least"), F.percentile_approx(key, at or [0.5], 20 * buckets).alias("at")).first()
    return [] if row["least"] is None else sorted({row["least"], *(row["at"] if at else [])})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Number of the last bound that the key reaches: a binary search in a literal array."""
    steps = max(1, len(bounds)).bit_length()
    array = F.lit(bounds).cast(T.ArrayType(T.LongType()))
    return F.aggregate(
        F.lit([1 << i for i in reversed(range(steps))]),
        F.lit(0),
        lambda at,
        step: F.when(F.coalesce(F.get(array, at + step) <= key, F.lit(False)), at + step).otherwise(at),
    )


def order_minhash(docs: DataFrame, k: int = 3, m: int = 64, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses."""
    spark = docs.sparkSession
    if buckets is None:  # several a partition, so that hashing them deals evenly
        buckets = 12 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = columns(docs, doc_id="long", text="string")
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LONG_MIN)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows.select("key"), "key", buckets)
    if not bounds:
        bounds = [0]
    own = bucket_of(F.col("key"), bounds)
    rows = rows.withColumn("own", own)
    # A bucket's first key is its bound; its rows also stand after the bucket before (the last one's is the first's).
    first = F.get(F.lit(bounds).cast(T.ArrayType(T.LongType())), F.col("own")) == F.col("key")
    before = F.pmod(F.col("own") - 1, F.lit(len(bounds)))
    dealt = rows.select(
        "doc_id",
        "key",
        "text",
        F.explode(F.when(
            first,
            F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("halo")), F.struct(before.alias("bucket"), F.lit(1).alias("halo"))),
        ).otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("halo"))))).alias("to"),
    )
    dealt = dealt.select("doc_id", "key", "text", "to.bucket", "to.halo").repartition("bucket")
    printed = fingerprint_columns(dealt, "text", "fingerprint", k, m)
    order = Window.partitionBy("bucket").orderBy("halo", "key", "text")
    printed = printed.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order)).where("halo = 0")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    printed = printed.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("next"), edited.alias("edited"))
    printed = fingerprint_columns(printed, "edited", "edited_fingerprint", k, m)
    return printed.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), m).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next"), m).alias("near_next"),
    )
