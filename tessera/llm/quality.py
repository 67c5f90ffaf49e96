"""Operator 7: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes.  A passage is encoded
from its letters and marks: counts of each character class, counts of class
pairs, the share of distinct words and word lengths; a hidden layer h follows.
Gated attention a_k = softmax(w . (tanh(V h_k) * sigmoid(U h_k))) is learned
from document labels alone, and the score is the logistic value of the weighted
passage representation sum a_k h_k.  Passages are encoded apart (a word that a
passage's edge cuts is two words), so no more than ``BLOCK`` are in work at once.

Only the fit reads labels: of each label, the ``SAMPLE`` rows with the least
hash among those with crc32(doc_id) mod 3 other than 1, weighted back to the
labels' shares.  So what reaches the driver is bounded.

Defined cases: null and empty texts are one empty passage; a null ``doc_id``
is not held out and trains nothing; of several labels of a document the least
counts; rows that share a ``doc_id`` are scored each; without labels of both
kinds every score is the share of label 1 (1.0 without labels); extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.neardup import word_hashes
from tessera.llm.tokens import forget, text_blocks
from tessera.llm.util import columns, free_name

PASSAGE = 768
BLOCK = 256  # passages whose features are worked out at once, so that a long text takes no more room than its features
SAMPLE = 1500
HIDDEN, GATE = 24, 12
MARKS = "!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
_CLASS = np.full(256, 2, dtype=np.int64)  # 0 space, 1 line break, 2 other, 3 capital, 4 digit, 5 beyond ASCII, then letters, then marks
_CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]] = 0, 1
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 3, 4, 5
_CLASS[97:123] = np.arange(6, 32)
_CLASS[[ord(c) for c in MARKS]] = np.arange(32, 32 + len(MARKS))
CLASSES = 32 + len(MARKS)
_COARSE = np.minimum(np.where((_CLASS >= 6) & (_CLASS < 32), 6, np.where(_CLASS >= 32, 7, _CLASS)), 7)
WIDTH = CLASSES + 64 + 4


def passages_of(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """(passages, each with a space at its end, number of passages of each text)."""
    raw = [t.encode("utf-8", "surrogatepass") or b" " for t in texts]
    return [r[at : at + PASSAGE] + b" " for r in raw for at in range(0, len(r), PASSAGE)], np.array([-(-len(r) // PASSAGE) for r in raw], dtype=np.int64)


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); a passage's features depend on its bytes alone."""
    passages, counts = passages_of(texts)
    return np.concatenate([_features(passages[at : at + BLOCK]) for at in range(0, len(passages), BLOCK)]), counts


def _features(raw: list[bytes]) -> np.ndarray:
    n, sizes = len(raw), np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    place = np.repeat(np.arange(n), sizes)
    total = sizes.astype(np.float64)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    single = np.bincount(place * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    out[:, :CLASSES] = np.sqrt(single / total[:, None])
    coarse = _COARSE[data]
    same = place[:-1] == place[1:]
    pairs = np.bincount((place[:-1] * 64 + coarse[:-1] * 8 + coarse[1:])[same], minlength=n * 64).reshape(n, 64)
    out[:, CLASSES : CLASSES + 64] = np.sqrt(pairs / total[:, None])
    hashes, first = word_hashes(data)
    at = place[first]
    words = np.maximum(np.bincount(at, minlength=n), 1)
    # A passage's number takes the high bits of a hash's place: equal words of a passage are equal keys.
    keys = np.unique((hashes & np.uint64(0xFFFFFFFF)) | (at.astype(np.uint64) << np.uint64(32)))
    distinct = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=n)
    out[:, -4] = distinct / words
    out[:, -3] = np.log1p(total / words)
    out[:, -2] = np.log1p(words)
    out[:, -1] = (total <= PASSAGE).astype(np.float32)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, x: np.ndarray, counts: np.ndarray) -> dict:
    """All layers for the passages x of bags of ``counts`` passages."""
    first = np.cumsum(counts) - counts
    bag = np.repeat(np.arange(len(counts)), counts)
    x = (x - p["mean"]) / p["spread"]
    h = np.maximum(x @ p["W"] + p["b"], 0)
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    raw = (t * g) @ p["w"]
    raw = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
    a = raw / np.add.reduceat(raw, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "first": first, "score": _sigmoid(z @ p["c"] + p["d"])}


def gradients(p: dict, f: dict, y: np.ndarray, weight: np.ndarray) -> dict:
    bag, h, a = f["bag"], f["h"], f["a"]
    dz_out = (f["score"] - y) * weight / len(y)
    dz = dz_out[:, None] * p["c"]
    da = (dz[bag] * h).sum(axis=1)
    draw = a * (da - np.add.reduceat(a * da, f["first"])[bag])
    gate = draw[:, None] * p["w"]
    dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
    dh = (dz[bag] * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (h > 0)
    return {"c": f["z"].T @ dz_out, "d": dz_out.sum(), "w": (f["t"] * f["g"]).T @ draw, "V": h.T @ dt, "U": h.T @ dg, "W": f["x"].T @ dh, "b": dh.sum(axis=0)}


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 25, rate: float = 0.004, batch: int = 64) -> dict:
    """Adam on the weighted logistic loss, from a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(7))
    every = np.concatenate(bags)
    p = {"mean": every.mean(axis=0), "spread": every.std(axis=0) + 0.02, "b": np.zeros(HIDDEN), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
    p |= {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE))}
    first, second, step = {}, {}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = np.concatenate([bags[i] for i in rows])
            got = gradients(p, forward(p, x, np.array([len(bags[i]) for i in rows])), y[rows], weight[rows])
            step += 1
            for k, g in got.items():
                g = g + (1e-4 * p[k] if k in "WVUc" else 0)
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                p[k] = p[k] - rate * 0.93**epoch * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: np.asarray(v, dtype=np.float32) for k, v in p.items()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Parameters from a bounded sample; {"share": ...} where nothing can be learned."""
    known = columns(labels, doc_id="long", quality="int").where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return {"share": np.float32(1.0 if not seen or 1 in seen else 0.0)}
    picked = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in picked], "doc_id long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for first, texts in text_blocks(batch, chars=250_000):
                x, counts = passage_features(texts)
                ends = np.cumsum(counts)
                bags = [x[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(bags, pa.binary())],
                    names=["doc_id", "quality", "bag"],
                )

    rows = columns(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = sorted(rows.mapInArrow(run, "doc_id long, quality int, bag binary").collect(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    y = np.array([r["quality"] for r in rows], dtype=np.float64)
    if len(set(y)) < 2:
        return {"share": np.float32(y.mean() if len(y) else 1.0)}
    share = np.array([seen[0], seen[1]]) / sum(seen.values())
    weight = (share / np.array([(y == 0).mean(), (y == 1).mean()]))[y.astype(int)]
    return fit([np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, WIDTH) for r in rows], y, weight)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; with ``keep`` the documents of that score at least, with all their columns."""
    params = train(docs, labels, sample)

    def scores(texts: list[str]) -> np.ndarray:
        if "share" in params:
            return np.full(len(texts), float(params["share"]))
        return forward(params, *passage_features(texts))["score"].astype(np.float64)

    chars = 250_000

    if keep is not None:
        name = free_name(docs, "_score")
        at = docs.columns.index("text")

        def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                got = [scores(texts) for _, texts in text_blocks(pa.RecordBatch.from_arrays([batch.column(at)], names=["text"]), chars=chars)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else [], pa.float64())], names=[*batch.schema.names, name])
            forget()

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.mapInArrow(run_all, f"{fields}, `{name}` double").where(F.col(name) >= keep).drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for first, texts in text_blocks(batch, chars=chars):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(scores(texts), pa.float64())], names=["doc_id", "score"])
        forget()

    out = columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
