"""Operator 9: benchmark decontamination over a positional inverted index, with DataFrame functions only.

1. Every document's words are hashed to terms.  Those that can be terms of test items (by a
   filter of bits of bounded size) are written in text order.
2. A test window is its terms with their offsets, ordered from the rarest in the corpus.  The
   postings (term, row, position) of all windows' rarest terms, and of their second rarest where
   that list is at most ``LONGER`` times as long, are written as lists: sorted by term, row and
   position, and dealt by term and a share of the rows, so that a frequent term's list is spread
   over ``SHARES`` parts.
3. A window's lists, moved back by their offsets, are intersected: what is left starts in the
   same place of the same document.
4. There the other terms are looked up at their offsets, from the next rarest on.  What
   remains is an exact phrase; with ``slop`` > 0 each term may lie so many positions
   off, which gives proximity matches.

All sizes take the same way; only which tables are broadcast depends on their counted size.

Defined cases: a null text has no words; an item without words has no windows;
an item of fewer words than ``window`` is one window; repeated rows are judged
each; a null ``item_id`` is left out of the item list; an empty table (either)
gives no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.util import ascii_lower, columns, discard, free_name, materialize
from tessera.operators.components import HOT, join_hot

#: Everything of ASCII but digits and letters splits words; all else belongs to them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows, or texts' keys, of which a table is broadcast.
MAX_BROADCAST = 100_000
LONGER = 2
SHARES = 64
#: Bits of a filter of terms at most (half a megabyte), and for each term.
MAX_BITS, BITS = 1 << 22, 16


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, terms): every run of ``window`` words; a shorter item is one run."""
    rows = columns(items, item_id="string", text="string").select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("h") - (window - 1), F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("h"), i, window))).alias("terms"))


def filter_of(terms: DataFrame):
    """A test whether a term can be among these: one bit for each, which other terms may share."""
    spark, bits = terms.sparkSession, 1 << 10
    while bits < min(MAX_BITS, BITS * terms.count()):
        bits *= 2
    word, bit = F.pmod(F.shiftright("term", 6), F.lit(bits // 64)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("term").bitwiseAND(F.lit(63)).cast("int"))
    used = terms.select(word.alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = spark.range(bits // 64).join(used, "id", "left").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("f"))
    row = every.select(F.transform("f", lambda x: x["bits"]).alias("f"))._jdf.first()
    table = Column(spark._jvm.org.apache.spark.sql.functions.lit(row.get(0)))  # never leaves the JVM

    def maybe(term: Column) -> Column:
        at = F.pmod(F.shiftright(term, 6), F.lit(bits // 64)).cast("int")
        return F.call_function("shiftrightunsigned", F.get(table, at), term.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return maybe


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, terms, ats): each document's possible terms and their positions in text order; written."""
    rows = columns(docs, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", word_hashes(F.col("text")).alias("h"))
    maybe = filter_of(terms)
    postings = F.filter(F.transform(F.col("h"), lambda h, i: F.struct(h.alias("term"), i.alias("at"))), lambda p: maybe(p["term"]))
    rows = rows.select("row", "doc_id", F.size("h").cast("long").alias("n_words"), postings.alias("p"))
    return materialize(rows.select("row", "doc_id", "n_words", F.col("p.term").alias("terms"), F.col("p.at").alias("ats")), "index")


def posting_lists(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, row, at, place): the lists of these terms in order; place: the posting's number among its document's; written."""
    maybe = filter_of(terms)
    places = F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.get("ats", i).alias("at"), i.alias("place")))
    rows = index.select("row", F.inline(F.filter(places, lambda p: maybe(p["term"])))).select("term", "row", "at", "place")
    dealt = rows.repartition(F.col("term"), F.pmod(F.xxhash64("row"), F.lit(SHARES)))
    return materialize(dealt.sortWithinPartitions("term", "row", "at"), "postings")


def find_windows(index: DataFrame, windows: DataFrame, window: int, slop: int = 0) -> DataFrame:
    """(row, wid, start, size): where windows (wid, terms) occur in the indexed documents."""
    known = windows.limit(MAX_BROADCAST + 1).count()
    small = F.broadcast if known <= MAX_BROADCAST else (lambda df: df)
    entries = windows.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    used = entries.groupBy("term").agg(F.count("*").alias("windows"))
    counts = index.select(F.explode("terms").alias("term")).join(small(used), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    counts = materialize(counts.join(used, "term"), "counts")
    entry = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("offset"), F.col("term"))
    frequent = counts.where(F.col("windows") > max(1.0, window * known * HOT)).select("term")  # terms of many windows
    ranked = join_hot(entries, counts.select("term", "n"), "term", frequent, "left").groupBy("wid", "size").agg(F.sort_array(F.collect_list(entry)).alias("by_count"))
    ranked = materialize(ranked.where(F.col("by_count")[0]["n"] > 0), "windows")  # a term that the corpus lacks: the window cannot occur

    two = (F.col("size") > 1) & (F.get("by_count", F.lit(1))["n"] <= F.col("by_count")[0]["n"] * LONGER)
    lists = ranked.select("wid", "size", two.alias("two"), F.posexplode(F.slice("by_count", 1, F.when(two, 2).otherwise(1))).alias("rank", "t"))
    lists = lists.select("wid", "size", "two", "rank", "t.term", "t.offset", "t.n")
    lists = materialize(lists, "wanted")
    postings = posting_lists(index, lists.select("term").distinct())
    least = max(1.0, postings.count() * HOT)

    def starts(rank: int) -> DataFrame:
        """(wid, row, start, place) by the lists of the windows' rarest or second rarest term."""
        wanted = lists.where(F.col("rank") == rank).select("term", "wid", "size", "two", "offset", "n")
        if known <= MAX_BROADCAST:
            found = postings.join(F.broadcast(wanted), "term")
        else:
            found = join_hot(postings, wanted, "term", wanted.where(F.col("n") > least).select("term").distinct())
        return found.select("wid", "size", "two", "row", (F.col("at") - F.col("offset")).alias("start"), "place")

    first = starts(0).where(F.col("start") >= -slop)
    second = starts(1).select("wid", "row", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)).alias("start")).distinct()
    both = first.where("two").join(second, ["wid", "row", "start"], "left_semi").unionByName(first.where("NOT two"))
    both = both.join(small(ranked.select("wid", "by_count")), "wid")
    both = materialize(both.groupBy("row").agg(F.collect_list(F.struct("wid", "start", "size", "place", "by_count")).alias("found")), "starts")

    # A term of the window lies among the document's possible terms as far from the first list's as in the text, or less far with ``slop``.
    def there(c: Column, t: Column, i: Column) -> Column:
        return (F.get("terms", i) == t["term"]) & (F.abs(F.get("ats", i) - c["start"] - t["offset"]) <= slop)

    def found(c: Column, t: Column) -> Column:
        place = c["place"] + t["offset"] - c["by_count"][0]["offset"]
        if not slop:
            return there(c, t, place)
        reach = window - 1 + slop
        return F.exists(F.sequence(F.greatest(c["place"] - reach, F.lit(0)), c["place"] + reach), lambda i: there(c, t, i))

    whole = F.filter("found", lambda c: F.forall(c["by_count"], lambda t: F.coalesce(found(c, t), F.lit(False))))
    hits = both.join(index.select("row", "terms", "ats"), "row").select("row", F.explode(whole).alias("c"))
    hits = materialize(hits.select("row", "c.wid", "c.start", "c.size").distinct(), "hits")
    discard(ranked, lists, postings, both, counts)
    return hits


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (and its row number)."""
    return judge(docs, items, window, slop)[0]


def judge(docs: DataFrame, items: DataFrame, window: int, slop: int) -> tuple[DataFrame, list[DataFrame]]:
    """The verdicts, and the written tables that they read."""
    found = item_windows(items, window)
    windows = materialize(found.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("wid", F.xxhash64("terms")), "items")
    index = build_index(docs, windows.select(F.explode("terms").alias("term")).distinct())
    hits = find_windows(index, windows.select("wid", "terms"), window, slop)

    first = F.greatest(F.col("start"), F.lit(0))
    last = F.least(F.col("start") + F.col("size"), F.col("n_words")) - 1
    sizes = index.select("row", "doc_id", "n_words")
    marked = hits.join(sizes.select("row", "n_words"), "row") if slop else hits.withColumn("n_words", F.lit((1 << 31) - 1))
    marked = marked.select("row", F.explode(F.sequence(first, last)).alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    listed = hits.select("row", "wid").distinct().join(windows.select("wid", "items"), "wid")
    listed = listed.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    whole = sizes.join(marked, "row", "left").join(listed, "row", "left")
    names = F.coalesce(F.array_join("items", ","), F.lit(""))
    out = whole.select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
    return out, [windows, index, hits]


def clean_rows(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any hit, with all their columns.

    Row numbers of the index would have to be those of another scan, so the
    verdict is joined by the text's hash: equal texts have equal verdicts.
    """
    name = free_name(docs, "_text")
    key = F.coalesce(F.xxhash64("text", F.lit(0)), F.lit(0))
    judged, read = judge(columns(docs, text="string").select(key.alias("doc_id"), "text"), items, window, 0)
    bad = materialize(judged.groupBy(F.col("doc_id").alias(name)).agg(F.max("contaminated").alias("bad"), F.count("*").alias("n")), "judged")
    discard(*read)
    rows = docs.withColumn(name, key)
    if bad.where("bad").limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(bad.where("bad").select(name)), name, "left_anti").drop(name)
    hot = F.broadcast(bad.where(F.col("n") > max(1.0, bad.agg(F.sum("n")).first()[0] * HOT)))
    many = rows.join(hot.where("bad"), name, "left_anti").join(hot, name, "left_semi")
    rest = rows.join(hot, name, "left_anti").join(bad.where("bad"), name, "left_anti")
    return many.unionByName(rest).drop(name)
