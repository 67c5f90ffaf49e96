"""Operator 3: near-duplicates by circulant MinHash, confirmed on full shingle sets.

Two permutations make the whole signature: one scatters a shingle's hash to a
place of a circle of ``CIRCLE`` slots, the other numbers the slots, and
coordinate k is the least number found k slots on from the set's places.  So a
set's signature is the column-wise minimum of slices of one table.

1. Sketch: every document's distinct shingles give its set's digest, size,
   signature and band keys.  Equal sets are one class from here on.
2. Bounds: a set's shingles that occur in any other class with a common bucket
   are all it can share.  So a heavily edited copy, many of whose shingles are
   its own, meets no partner.  They are counted by parts of the hash range: two
   sets share at most the sum, over the parts, of the lesser count.
3. Star rounds: in each, a share of the bands links its buckets' classes to a few
   classes of the bucket (its most typical one among them), where both are of
   different components as yet.  Pairs that the bounds or signatures rule out are
   dropped (a signature agreement below ``SKETCH`` is over six standard deviations
   off for a link), the others are confirmed on their whole sets.
4. Components after each round: large-star and small-star until nothing changes.
5. Last, the buckets of all bands that still hold classes of several components
   pair classes of different components and of near sizes that the bounds allow.
   Sizes are dealt in steps of a factor 100 / percent, and only equal and neighbouring
   steps can meet; buckets of more than ``SPLIT`` classes are dealt to several tasks.

So a group of m copies costs m links, not m squared, and a link is left out
only between classes that other links already connect.  At a similarity of 0.8
the chance that no band of 32 catches a link is 3e-6.

Defined cases: a null text has no words; a document without words is linked
with nothing; fewer words than ``shingle`` make one shingle; rows that share a
``doc_id`` are judged by their texts; a null ``doc_id`` never names a component
and a component of such rows alone has the id null (``kept`` is then false); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import forget, text_blocks
from tessera.llm.util import columns, discard, materialize
from tessera.operators.components import HOT, connect, join_hot

BANDS, ROWS = 32, 5
WIDTH = BANDS * ROWS
CIRCLE = 1 << 20
STAR_ROUNDS = 2
#: Classes of an open bucket that one task pairs with the rest of it.
SPLIT = 500
#: A bucket's centers are its least classes by node XOR turn, other ones each round.
_TURNS = [[0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D], [0x369DEA0F31A53F85, 0x27BB2EE687B0B0FD, 0x1B873593CC9E2D51]]
#: Coordinates (their low four bits) that a link's classes have in common at least.  At a
#: similarity of 0.8 they have 130 of 160 on average, with a deviation of 4.9: this is over six deviations below.
SKETCH = 100
#: Parts of the hash range in which shared shingles are counted; three counts of 21 bits fill a number.
PARTS, FIELD = 33, 21
NIBBLES = 4 * np.arange(16, dtype=np.int64)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd: multiplies without loss
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_POWERS: list[np.ndarray] = []
_TABLE: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes hashed at a time: what a worker holds for it does not grow with a text.
CHUNK = 1 << 18


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_STEP**i and its inverse for i <= CHUNK, kept by the worker."""
    if not _POWERS:
        up, down = np.full(CHUNK + 1, _STEP), np.full(CHUNK + 1, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of lower-cased bytes."""
    return word_spans(data)[:2]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, last byte + 1) of each word of lower-cased bytes: differences of a running sum of bytes times powers."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.append(0, edge)
    if len(data) and not space[-1]:
        edge = np.append(edge, len(data))
    up, down = _powers()
    total, back = np.zeros(len(edge), dtype=np.uint64), np.zeros(len(edge), dtype=np.uint64)
    run, far, near = (np.full(1, x, dtype=np.uint64) for x in (0, 1, 1))  # the sum, the power and its inverse up to here
    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK]
        local = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=local[1:])
        low, high = np.searchsorted(edge, [a, a + len(part)])
        high = len(edge) if a + len(part) == len(data) else high
        at = edge[low:high] - a
        total[low:high] = run + far * local[at]
        back[low:high] = near * down[at]
        run, far, near = run + far * local[-1:], far * up[len(part)], near * down[len(part)]
    return mix((total[1::2] - total[::2]) * back[::2]), edge[::2], edge[1::2]


def shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    if not len(data):
        return [np.zeros(0, dtype=np.uint64) for _ in raw]
    words, first = word_hashes(data)
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    rolled = words.copy()
    for k in range(1, shingle):
        rolled[: len(words) - k] = mix(rolled[: len(words) - k] * _STEP + words[k:])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(rolled[a : b - shingle + 1]))
        elif b > a:
            whole = words[a : a + 1]
            for i in range(a + 1, b):
                whole = mix(whole * _STEP + words[i : i + 1])
            out.append(mix((whole ^ _STEP) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def circle() -> np.ndarray:
    """Slices of the second permutation: row p holds the numbers of slots p, p+1, ..., p+WIDTH-1."""
    if not _TABLE:
        numbers = np.random.Generator(np.random.PCG64(20)).permutation(CIRCLE).astype(np.uint32)
        _TABLE.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([numbers, numbers[:WIDTH]]), WIDTH))
    return _TABLE[0]


def signature(values: np.ndarray) -> np.ndarray:
    """WIDTH coordinates of a non-empty set; the first permutation is a mix of its hashes."""
    table, places = circle(), (mix(values ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(CIRCLE - 1)).astype(np.int64)
    out = np.full(WIDTH, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(places), 1024):
        np.minimum(out, table[places[at : at + 1024]].min(axis=0), out=out)
    return out


def band_keys(sign: np.ndarray) -> np.ndarray:
    """A 63-bit key of each band, the band's number mixed in."""
    rows = sign.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * _STEP + rows[:, r])
    return (key >> np.uint64(1)).astype(np.int64)


def set_digest(values: np.ndarray) -> int:
    """63 bits that name a set: a sum of mixed hashes, and its size."""
    total = np.add.reduce(mix(values + _STEP)) ^ mix(np.array([len(values)], dtype=np.uint64))[0]
    return int(mix(np.array([total]))[0] >> np.uint64(1))


def part_counts(values: np.ndarray) -> list[int] | None:
    """How many hashes lie in each part, three counts a number; none for sets too large for the fields."""
    if len(values) >= 1 << FIELD:
        return None
    counts = np.bincount((values % np.uint64(PARTS)).astype(np.int64), minlength=PARTS).reshape(-1, 3)
    return (counts << (FIELD * np.arange(3))).sum(axis=1).tolist()


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, n_shingles, node, sign, keys, parts), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_blocks(batch):
                sizes, nodes, signs, keys, parts = [], [], [], [], []
                for values in shingle_sets(texts, shingle):
                    sizes.append(len(values))
                    if len(values):
                        sign = signature(values)
                        nodes.append(set_digest(values))
                        signs.append(((sign & 0xF).astype(np.int64).reshape(-1, 16) << NIBBLES).sum(axis=1))
                        keys.append(band_keys(sign))
                        parts.append(part_counts(values))
                    else:
                        nodes.append(None)
                        signs.append(None)
                        keys.append(None)
                        parts.append(None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signs, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n_shingles", "node", "sign", "keys", "parts"],
                )
        forget()

    return materialize(keyed(docs).mapInArrow(run, "doc_id long, row long, n_shingles long, node long, sign array<long>, keys array<long>, parts array<long>"), "sketch")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): a key that equal rows share and others do not."""
    return columns(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, values) of the wanted nodes; wanted: (row, node), one row a node; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for first, texts in text_blocks(batch):
                kept, values = [], []
                for node, found in zip(nodes[first:], shingle_sets(texts, shingle), strict=False):
                    if len(found) and set_digest(found) == node:
                        kept.append(node)
                        values.append(found.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(values, pa.binary())], names=["node", "values"])
        forget()

    found = keyed(docs).join(wanted, "row").select("node", "text")
    return materialize(found.mapInArrow(run, "node long, values binary").dropDuplicates(["node"]), "sets")  # equal rows come twice


def confirm(sets: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                mask.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(mask, pa.bool_()))

    shape = "a long, b long"
    for side in "ab":
        if f"{side}_sign" not in pairs.columns:
            pairs = pairs.join(classes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("sign", "parts", "size")]), side)
    pairs = materialize(pairs.where(alike()).where(meets(percent)).select("a", "b"), "candidates")
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("values").alias(f"{side}_values")), side)
    return materialize(pairs.select("a", "b", "a_values", "b_values").mapInArrow(similar, shape), "links")


def with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        found = members.withColumn("root", F.col("node"))
    else:
        found = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return materialize(found.select("key", "node", "size", "shared", "root"), "rooted")


def mixed_buckets(members: DataFrame, *more) -> DataFrame:
    """Buckets whose members are of several components."""
    return members.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), *more).where("_low <> _high")


def sided(members: DataFrame, side: str, meet: tuple = ("key",)) -> DataFrame:
    return members.withColumnsRenamed({"node": side, **{c: f"{side}_{c}" for c in members.columns if c not in (*meet, "node")}})


def reachable(percent: int):
    """Whether a and b could be similar enough, by what each has in common with any other."""
    most = F.least("a_shared", "b_shared")
    return most * 100 >= (F.col("a_size") + F.col("b_size") - most) * percent


def meets(percent: int):
    """Whether a and b could be similar enough, by the lesser of their shared shingles in each part."""
    mask = F.lit((1 << FIELD) - 1)

    def least(x: Column, y: Column) -> Column:
        fields = [[F.shiftrightunsigned(z, FIELD * i).bitwiseAND(mask) for z in (x, y)] for i in range(3)]
        return F.least(*fields[0]) + F.least(*fields[1]) + F.least(*fields[2])

    most = F.aggregate(F.zip_with("a_parts", "b_parts", least), F.lit(0).cast("long"), lambda n, x: n + x)
    bound = most * (100 + percent) >= (F.col("a_size") + F.col("b_size")) * percent
    return F.col("a_parts").isNull() | F.col("b_parts").isNull() | bound


def alike():
    """Whether the signatures of a and b agree in at least ``SKETCH`` coordinates."""
    differ = F.lit(0)
    for i in range(WIDTH // 16):
        x = F.col("a_sign")[i].bitwiseXOR(F.col("b_sign")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= WIDTH - SKETCH


def shared_sizes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shared, parts): how many of a set's shingles occur in any other of these sets, in all and by parts.

    No two sets have more in common than that, so a heavily edited copy, most of
    whose shingles are its own, meets no partner at all.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(values.as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node), pa.int64()), pa.array(found, pa.int64())], names=["node", "value"])

    values = sets.mapInArrow(single, "node long, value long")
    own = values.groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    # The part of a hash read as unsigned: 2**64 is 16 more than a multiple of 33.
    part = F.pmod(F.pmod("value", F.lit(PARTS)) + F.when(F.col("value") < 0, F.lit((1 << 64) % PARTS)).otherwise(F.lit(0)), F.lit(PARTS)).cast("int")
    unit = F.element_at(F.lit([1 << FIELD * i for i in range(3)]), F.col("part") % 3 + 1)
    own = own.select("node", part.alias("part")).select("node", F.floor(F.col("part") / 3).alias("at"), unit.alias("one"))
    own = own.groupBy("node").agg(
        F.count("*").alias("own"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("at") == i, F.col("one"))), F.lit(0).cast("long")) for i in range(PARTS // 3)]).alias("own_parts"),
    )
    found = classes.select("node", "n_shingles", "parts").join(own, "node", "left")
    left = F.when(F.col("own").isNull(), F.col("parts")).otherwise(F.zip_with("parts", "own_parts", lambda x, y: x - y))
    return found.select("node", (F.col("n_shingles") - F.coalesce("own", F.lit(0))).alias("shared"), left.alias("parts"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    sketches, made = sketch(docs, shingle), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, name))
        return made[-1]

    filled = sketches.where("node IS NOT NULL")
    # One row a class: the row of its least doc_id, any of those that are equal in all.
    least = filled.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"), F.count("*").alias("copies"))
    least = keep(least.select(F.col("node").alias("least_node"), F.col("least.doc_id").alias("least_id"), F.col("least.row").alias("least_row"), "copies"), "least")
    first = filled.join(least, (F.col("node") == F.col("least_node")) & (F.col("row") == F.col("least_row")))
    classes = keep(first.select("node", "row", "n_shingles", "sign", "keys", "parts").dropDuplicates(["node"]), "classes")

    # Classes that share a bucket, and what each could have in common with any other.
    members = classes.select(F.posexplode("keys").alias("band", "key"), "node", F.col("n_shingles").alias("size"))
    crowded = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = keep(members.join(crowded, "key", "left_semi"), "crowded")
    crowd = keep(classes.join(members.select("node").distinct(), "node", "left_semi"), "crowd")
    sets = full_sets(docs, crowd.select("row", "node"), shingle)  # the texts are read again only here
    shared = keep(shared_sizes(sets, crowd), "shared")
    crowd = keep(crowd.drop("parts").withColumnRenamed("n_shingles", "size").join(shared, "node"), "bounded")
    members = keep(members.join(shared.select("node", "shared"), "node").where((F.col("shared") * 100 >= F.col("size") * percent)), "members")

    links, roots = None, None
    for some in range(STAR_ROUNDS):
        here = with_roots(members.where(F.col("band") % STAR_ROUNDS == some), roots)
        turns = [F.lit(t) for t in _TURNS[some]]
        firsts = [F.min(F.col("node").bitwiseXOR(t)).bitwiseXOR(t).alias(f"c{i}") for i, t in enumerate(turns)]
        typical = F.max_by("node", F.col("shared") / F.col("size")).alias("c")
        heads = mixed_buckets(here, typical, *firsts).select("key", F.explode(F.array_distinct(F.array("c", *[f"c{i}" for i in range(len(turns))]))).alias("a"))
        left = sided(here, "a").join(heads, ["key", "a"], "left_semi")
        pairs = left.join(sided(here, "b"), "key").where("a_root <> b_root").where(reachable(percent))
        found = confirm(sets, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), crowd, percent)
        if links is None or found.limit(1).count():
            links = found if links is None else links.union(found)
            roots = connect(links)

    rest = with_roots(members, roots)
    crowded = mixed_buckets(rest, F.count("*").alias("_n")).select("key", F.ceil(F.col("_n") / SPLIT).cast("int").alias("tasks"))
    rest = rest.join(crowded, "key").join(crowd.select("node", "keys", "sign", "parts"), "node")
    step = F.floor(F.log(F.col("size")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rest = keep(rest.withColumn("step", step), "open")
    # A bucket's classes meet by size: a in the steps of its size and the next one, b in its own; larger buckets are dealt to several tasks by a's node.
    salt = F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int")
    left = rest.withColumn("salt", salt).withColumn("at", F.explode(F.array("step", F.col("step") + 1)))
    right = rest.withColumn("at", F.col("step")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    meet = ("key", "at", "salt")
    pairs = sided(left.drop("tasks"), "a", meet).join(sided(right.drop("tasks"), "b", meet), list(meet))
    once = (F.col("a_step") < F.col("b_step")) | (F.col("a") < F.col("b"))  # of one step: each pair from one side
    pairs = pairs.where(once).where("a_root <> b_root").where(reachable(percent))
    pairs = pairs.where(alike()).where(meets(percent)).where(F.col("key") == F.array_intersect("a_keys", "b_keys")[0])  # each pair in one bucket
    pairs = pairs.select("a", "b", *[f"{side}_{c}" for side in "ab" for c in ("sign", "parts", "size")])
    found = confirm(sets, pairs, crowd, percent)
    if found.limit(1).count():
        roots = connect(links.union(found))

    # Of each class its component, then of each row; the few largest components and classes are broadcast.
    named = least.select(F.col("least_node").alias("node"), "least_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = keep(named, "named")
    heads = keep(named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "heads")
    many = max(1.0, sketches.count() * HOT)
    named = join_hot(named.select("root", "node", "copies"), heads.select("root", "component_id"), "root", heads.where(F.col("n") > many))
    named = materialize(named.select("node", "component_id", "copies"), "components")
    discard(*made, sets)
    hot = named.where(F.col("copies") > many)
    labels = sketches.select("doc_id", "n_shingles", "node")
    out = join_hot(labels.where("node IS NOT NULL"), named.select("node", "component_id"), "node", hot).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(labels.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
