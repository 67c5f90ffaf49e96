"""Encoders: text to vectors, run in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of letters and digits of any script; ideographs, which are not parted by spaces, one at a time.
_WORDS = re.compile(r"[\u2e80-\u9fff\uac00-\ud7a3\uf900-\ufaff]|[^\W_\u2e80-\u9fff\uac00-\ud7a3\uf900-\ufaff]+")


class Encoder(Protocol):
    def encode(self, sentences: Sequence[str]) -> np.ndarray: ...


class HashedBigramEncoder:
    """Signed hashed counts of adjacent word pairs: lexical, deterministic, without weights."""

    def __init__(self, width: int = 1024):
        self.width = width

    def encode(self, sentences: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(sentences), self.width))
        for row, text in zip(out, sentences, strict=True):
            words = _WORDS.findall(text.lower())
            hashes = [int(hashlib.md5(f"{a} {b}".encode()).hexdigest()[:8], 16) for a, b in zip(words, words[1:], strict=False)]
            if hashes:
                h = np.array(hashes, dtype=np.int64)
                np.add.at(row, (h >> 1) % self.width, 1 - 2 * (h & 1))
        return out


class TableEncoder:
    """Vectors looked up by text."""

    def __init__(self, table: dict[str, Sequence[float]]):
        self.table = table

    def encode(self, sentences: Sequence[str]) -> np.ndarray:
        return np.array([self.table[s] for s in sentences], dtype=np.float64)


class StaticEncoder:
    """Mean of the vectors of a text's known words, of length 1: a static embedding model from a table of words and vectors.

    A text without known words is the zero vector.  The table is held by every worker, so it is
    bounded by its vocabulary.
    """

    def __init__(self, words: Sequence[str], vectors: np.ndarray):
        self.at, self.vectors = {w: i for i, w in enumerate(words)}, np.asarray(vectors, dtype=np.float32)

    @classmethod
    def from_table(cls, table: DataFrame, word: str = "word", vector: str = "vector", most: int = 2_000_000) -> StaticEncoder:
        """Reads a table of any source; more than ``most`` words are refused."""
        if table.limit(most + 1).count() > most:
            raise ValueError(f"a static encoder holds at most {most} words")
        found = table.select(word, F.col(vector).cast("array<float>")).toArrow()
        rows = found.column(1).combine_chunks()
        return cls(found.column(0).to_pylist(), rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))

    def encode(self, sentences: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(sentences), self.vectors.shape[1]))
        for row, text in zip(out, sentences, strict=True):
            known = [i for w in _WORDS.findall(text.lower()) if (i := self.at.get(w)) is not None]
            if known:
                row[:] = self.vectors[known].mean(axis=0)
                row /= max(1e-12, np.linalg.norm(row))
        return out


class CallableEncoder:
    """Any object with ``encode``, made by ``factory`` once in each Python worker."""

    def __init__(self, factory):
        self.factory, self._made = factory, None

    def __getstate__(self) -> dict:
        return {"factory": self.factory, "_made": None}

    def encode(self, sentences: Sequence[str]) -> Any:
        if self._made is None:
            self._made = self.factory()
        return self._made.encode(list(sentences))


def featurize(items: DataFrame, id_col: str, columns: Sequence[str], encoder: Encoder, batch: int = 512) -> DataFrame:
    """(id_col, vector): the columns' vectors, concatenated.  A null raises; fill it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                parts = []
                for c in range(1, part.num_columns):
                    if part.column(c).null_count:
                        raise ValueError("null cannot be encoded; fill it before")
                    parts.append(np.asarray(encoder.encode(part.column(c).to_pylist()), dtype=np.float64))
                vectors = np.concatenate(parts, axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=[id_col, "vector"])

    return items.select(id_col, *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, f"{id_col} long, vector array<double>")
