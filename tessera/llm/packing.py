"""Operator 4: order-preserving packing by dynamic programming.

The ids of a partition's documents form one stream.  Windows of at most
``capacity`` ids cover it in order; a window may end at a document's end (free),
at a sentence's end (``sentence_cost``) or, so that a text without sentences
still fits, at every ``step`` ids in between (``inner_cost``).  Over these cut
positions p the least cost is

    f(j) = cut(j) + min over p_j - p_i <= capacity of f(i) + capacity - (p_j - p_i) + window_cost

whose minimum of f(i) + p_i slides along a monotone queue; a window whose
length is ``capacity`` or half of it pays no padding.  The stream is solved in
segments of ``segment`` ids; the last window of a segment is solved again with
the next one, so memory stays bounded and no partial window is left inside.

Sequence ids are ``(partition << 32) + number``.  Defined cases: a null text
counts as empty (its only id is the end id); repeated rows are packed as often
as they occur; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.tokens import CACHE_WORDS, forget, text_blocks, tokenizer_path, worker_cache
from tessera.llm.util import columns

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_positions(ends: np.ndarray, sentences: np.ndarray, step: int, sentence_cost: int, inner_cost: int) -> tuple[list[int], list[int]]:
    """Ascending cut positions after 0 and what each costs; ends: documents' ends, the last is the stream's."""
    firm = np.union1d(ends, sentences)
    before = np.concatenate([[0], firm[:-1]])
    extra = (firm - before - 1) // step  # cuts inside a long stretch
    inner = np.repeat(before, extra) + step * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    at = np.concatenate([firm, inner])
    cost = np.concatenate([np.where(np.isin(firm, ends), 0, sentence_cost), np.full(len(inner), inner_cost)])
    order = np.argsort(at, kind="stable")
    return at[order].tolist(), cost[order].tolist()


def best_windows(at: list[int], cost: list[int], capacity: int, window_cost: int) -> list[int]:
    """Ends of the cheapest windows over cut positions ``at`` (gaps at most ``capacity``)."""
    at, n = [0, *at], len(at)
    index = {p: i for i, p in enumerate(at)}
    total, back = [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + p_i, i), values ascending
    half, left = capacity // 2, queue.popleft
    for j in range(1, n + 1):
        p = at[j]
        low = p - capacity
        while at[queue[0][1]] < low:
            left()
        value, i = queue[0]
        least = value + capacity - p
        if (k := index.get(p - half)) is not None and total[k] < least:
            least, i = total[k], k
        least += cost[j - 1] + window_cost
        total[j], back[j] = least, i
        value = least + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    ends = []
    while n:
        ends.append(at[n])
        n = back[n]
    return ends[::-1]


def sentence_end_ids(tokenizer: str) -> np.ndarray:
    """Which ids end a sentence: their text ends with a full stop, a mark or a line break."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    marks = (".", "!", "?", "…", "。", "\n")
    texts = [tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())]
    return np.array([t.rstrip(" \"')]»”").endswith(marks) or t.endswith("\n") for t in texts])


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 2048, step: int = 32, sentence_cost: int = 4, inner_cost: int = 12, window_cost: int = 64, segment: int = 400_000, cache_words: int = CACHE_WORDS
) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence.

    With fewer ``cache_words`` than by default a worker also frees them after each task: slower, but smaller beside other stages.
    """
    tokenizer = tokenizer or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()
    if step > capacity:
        raise ValueError("step must be at most capacity")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sequence = worker_cache(tokenizer, cache_words), TaskContext.get().partitionId() << 32
        closing = sentence_end_ids(tokenizer)
        names: list = []
        lens: list[int] = []
        parts: list[bytes] = []
        done = held = 0  # ids of the first document that are already packed; ids that wait

        def solve(last: bool) -> pa.RecordBatch | None:
            nonlocal names, lens, parts, done, held, sequence
            raw = b"".join(parts)
            ids = np.frombuffer(raw, dtype="<u4")
            size = np.array(lens, dtype=np.int64)
            open_size = size.copy()
            open_size[0] -= done
            ends = np.cumsum(open_size)
            marks = np.flatnonzero(closing[np.minimum(ids, len(closing) - 1)] & (ids < len(closing))) + 1
            cuts = best_windows(*cut_positions(ends, marks, step, sentence_cost, inner_cost), capacity, window_cost)
            if not last:
                cuts = cuts[:-1]
            if not cuts:
                return None
            limit = cuts[-1]
            edge = np.union1d(cuts, ends[ends < limit])
            start = np.concatenate([[0], edge[:-1]])
            doc = np.searchsorted(ends, start, side="right")
            window = np.searchsorted(cuts, start, side="right")
            opened = np.concatenate([[0], cuts])[window]
            in_doc = start - (ends - open_size)[doc] + np.where(doc == 0, done, 0)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), edge.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([names[d] for d in doc], pa.int64()), *[pa.array(v, pa.int64()) for v in (in_doc, edge - start, crc, size[doc], sequence + window, start - opened)]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts)
            k = int(np.searchsorted(ends, limit, side="right"))
            rest = raw[4 * limit :]
            if k < len(names):
                done = int(limit - (ends - open_size)[k]) + (done if k == 0 else 0)
            names, lens, parts, held = names[k:], lens[k:], [rest], len(rest) // 4
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in text_blocks(batch):
                for i, ids in enumerate(cache.encode(texts)):
                    names.append(keys[first + i])
                    lens.append(len(ids) // 4 + 1)
                    parts.append(ids + end)
                    held += lens[-1]
                    if held >= segment and (out := solve(False)) is not None:
                        yield out
        if names and (out := solve(True)) is not None:
            yield out
        if cache_words < CACHE_WORDS:
            del cache
            forget()

    return columns(docs, doc_id="long", text="string").mapInArrow(pack, SCHEMA)
