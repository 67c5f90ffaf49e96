"""Operator 2: token-ID output in Simple-8b word-aligned coding.

A file is a sequence of blocks; a block row holds whole documents:

* ``doc_ids``, ``doc_lens``: its documents in ascending ``doc_id`` order,
* ``words``: little-endian 64-bit words, a 4-bit selector above 60 data bits,
* ``offsets``: the first word of each run of 128 ids, so that runs decode
  independently and in step,
* ``shard``, ``shard_start``: its file and the ids of the file before it.

Selector 1 is a run of 120 zeros, selectors 2 to 15 pack 60 down to 1 ids, and
selector 0 is an escape: the next word is one raw 64-bit id (60 bits and over).

Defined cases: a null text counts as empty (its ids are the end id alone); a
null ``doc_id`` sorts first; rows that share a ``doc_id`` all stay, ordered by
text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import column_blocks, tokenizer_path, worker_blocks
from tessera.llm.util import columns, fresh_path

RUN = 128
#: Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

BLOCK_SCHEMA = "shard int, shard_start long, n_ids long, doc_ids array<long>, doc_lens array<int>, words binary, offsets array<int>"
DOC_SCHEMA = "shard int, shard_start long, doc_id long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each run's first word) of unsigned 64-bit ids."""
    n = len(ids)
    runs = -(-n // RUN)
    width = RUN + 120
    data = np.zeros((runs, width), dtype=np.uint64)
    flat = np.zeros(runs * RUN, dtype=np.uint64)
    flat[:n] = ids
    data[:, :RUN] = flat.reshape(runs, RUN)
    length = np.full(runs, RUN)
    if runs:
        length[-1] = n - RUN * (runs - 1)
    top = int(ids.max()) if n else 0
    least = np.full((runs, RUN), 16, dtype=np.uint8)  # the lowest selector each id has bits for is 16 less a count
    need = np.zeros((runs, width), dtype=np.uint8)  # how many of the selectors 1 to 15 are too narrow for an id
    small = flat.astype(np.uint32) if top < 1 << 32 else flat
    narrow = np.zeros(runs * RUN, dtype=np.uint8)
    for sel in range(1, 16):
        if top >= (1 << int(BITS[sel])):
            narrow += small >= small.dtype.type(1 << int(BITS[sel]))
    need[:, :RUN] = narrow.reshape(runs, RUN)
    # The most that the next ids need, for spans that double; any count is two such spans. Past the run's end there are zeros.
    # Whatever fits a selector fits all higher ones, which hold fewer and wider ids.
    span, most = 1, need
    for sel in range(15, 0, -1):
        count = int(COUNTS[sel])
        while 2 * span <= count:
            most, span = np.maximum(most[:, :-span], most[:, span:]), 2 * span
        far = count - span
        here = most[:, :RUN] if far == 0 else np.maximum(most[:, :RUN], most[:, far : far + RUN])
        least -= here < sel
    best = np.where(least == 16, 0, least).astype(np.uint8)
    # The chains of starts, all runs in step; then every selector's words at once.
    at, col, live = np.zeros(runs, dtype=np.int64), np.zeros(runs, dtype=np.int64), np.flatnonzero(length > 0)
    steps = []
    while len(live):
        here = at[live]
        sels = best[live, here]
        steps.append((live, here, col[live], sels))
        at[live] = here + COUNTS[sels]
        col[live] += 1 + (sels == 0)
        live = live[at[live] < length[live]]
    offsets = np.cumsum(col) - col
    words = np.zeros(int(col.sum()), dtype=np.uint64)
    if steps:
        run, start, to, sels = map(np.concatenate, zip(*steps, strict=True))
        flat, start, to = data.ravel(), run * width + start, offsets[run] + to
        for sel in np.unique(sels):
            rows = np.flatnonzero(sels == sel)
            first, into = start[rows], to[rows]
            if sel == 0:
                words[into + 1] = flat[first]
                continue
            value = np.full(len(rows), np.uint64(int(sel) << 60))
            for k in range(int(COUNTS[sel]) if BITS[sel] else 0):
                value |= flat[first + k] << np.uint64(k * int(BITS[sel]))
            words[into] = value
    return words, offsets.astype(np.int32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids again: every selector's words are decoded at once, each run from its own offset."""
    runs, width = len(offsets), RUN + 120
    out = np.zeros(runs * width, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(sel == 0):
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, COUNTS[sel])
    run = np.repeat(np.arange(runs), np.diff(np.append(offsets, len(words))))
    before = np.cumsum(count) - count
    at = run * width + (before - before[offsets[run]] if len(words) else before)
    for s in np.flatnonzero(np.bincount(sel[~raw], minlength=16)):
        rows = np.flatnonzero((sel == s) & ~raw)
        if s == 0:
            out[at[rows]] = words[rows + 1]
            continue
        bits, value, to = int(BITS[s]), words[rows], at[rows]
        for k in range(int(COUNTS[s]) if bits else 0):
            out[to + k] = (value >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    return out.reshape(runs, width)[:, :RUN].ravel()[:n]


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, block_ids: int = 400_000) -> DataFrame:
    """Block rows of all documents: range-partitioned and sorted by ``doc_id``, one shard a partition."""
    tokenizer = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        encoder = worker_blocks(tokenizer)
        schema = pa.schema([("shard", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32())), ("words", pa.binary()), ("offsets", pa.list_(pa.int32()))])
        keys: list = []
        lens: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, lens, parts, size, start
            words, offsets = pack(np.concatenate(parts))
            row = [shard, start, size, keys, lens, words.astype("<u8").tobytes(), offsets]
            start += size
            keys, lens, parts, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, texts in column_blocks(batch.column(1)):
                ids, each = encoder.encode(texts, end_id)
                ends, done = np.cumsum(each), 0  # done: documents of these texts that are taken
                while done < len(each):
                    taken = int(ends[done - 1]) if done else 0
                    past = min(len(each), int(np.searchsorted(ends, taken + block_ids - size)) + 1)
                    keys += names[first + done : first + past]
                    lens += each[done:past].tolist()
                    parts.append(ids[taken : ends[past - 1]])
                    size += len(parts[-1])
                    done = past
                    if size >= block_ids:
                        yield flush()
        if keys:
            yield flush()

    rows = columns(docs, doc_id="long", text="string")
    return rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text").mapInArrow(encode, BLOCK_SCHEMA)


def write_corpus(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    encode_documents(docs, tokenizer, end_id).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def block_ids(words: bytes, offsets, n: int) -> np.ndarray:
    return unpack(np.frombuffer(words, dtype="<u8"), np.asarray(offsets, dtype=np.int64), n).astype("<u4")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = block_ids(row["words"], row["offsets"], row["n_ids"])
                lens = np.array(row["doc_lens"], dtype=np.int64)
                ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - lens, ends, strict=True)]
                k = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * k, pa.int32()), pa.array(row["shard_start"] + ends - lens, pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "shard_start", "doc_id", "n_tokens", "ids_crc32"],
                )

    blocks = read_blocks(spark, path)
    # One row a shard: as many as there are files, whatever the corpus holds.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    docs = blocks.select("shard", "shard_start", "n_ids", "doc_ids", "doc_lens", "words", "offsets").mapInArrow(decode, DOC_SCHEMA)
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def simple8b_corpus(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the corpus to the shared folder, read it back, one row per document."""
    spark = docs.sparkSession
    path = fresh_path(spark, "simple8b")
    write_corpus(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
