"""Sub-word encoding with a public tokenizer file and a bounded cache of words.

A byte-level BPE tokenizer splits a text by a pattern before it merges.  The
pattern always begins a new piece at white space that follows a non-white
character, so a text can be cut there and each piece encoded once: the ids of
a text are the ids of its pieces in a row.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_DOUBLE = re.compile(r"\s\s")
_CUT = re.compile(r"(?= )(?<=\S)")

#: Words kept by a Python worker; when full the cache starts anew.
CACHE_WORDS = 1_000_000
#: Longer words are encoded anew each time, so the cache is bounded in bytes too.
LONGEST = 100
#: The pattern that BlockEncoder follows without a regular expression; with another, texts are encoded one by one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, SPACE, WHITE = range(1, 6)
#: Pieces that are merged in one call, with a byte between them that no text holds.
TOGETHER = 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 up."""
    out, spare = [], 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            out.append(chr(byte))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Pieces(dict):
    """Ids of the pieces that the pattern cuts."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class _Words(dict):
    """Ids of words, each read with ``prefix`` before it; words across lines are not kept."""

    def __init__(self, prefix: str, merge, pieces: _Pieces, cut):
        self.prefix, self.merge, self.pieces, self.cut = prefix, merge, pieces, cut

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # one piece
            ids = self.merge(self.prefix + word)
        else:
            ids = b"".join(map(self.pieces.__getitem__, self.cut(self.prefix + word)))
        if len(word) <= LONGEST and "\n" not in word:
            self[word] = ids
        return ids


class WordCache:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.most = CACHE_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = dict(enumerate(byte_letters()))
        self.model = self.tok.model
        self.reset()

    def reset(self) -> None:
        self.pieces = _Pieces(self._merge)
        self.spaced = _Words(" ", self._merge, self.pieces, self.cut)
        self.bare = _Words("", self._merge, self.pieces, self.cut)

    def _merge(self, piece: str) -> bytes:
        spelt = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return _bytes([t.id for t in self.model.tokenize(spelt)])

    def word(self, word: str) -> bytes:
        """Ids of a word after a space."""
        return self.spaced[word]

    def _simple(self, text: str) -> bool:
        """Whether no two white-space characters meet in it and none but spaces and line breaks occur."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return False
        return text.replace("\n", "").isprintable() or not _DOUBLE.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) + len(self.pieces) > self.most:
            self.reset()
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        out = []
        for text in texts:
            if any(s in text for s in self.special):
                out.append(_bytes(self.tok.encode(text, add_special_tokens=False).ids))
            elif not self._simple(text):
                out.append(b"".join(map(bare, _CUT.split(text))))
            else:
                words = text.split(" ")
                words[0] = bare(words[0])
                words[1:] = map(spaced, words[1:])
                out.append(b"".join(words))
        return out


class BlockEncoder:
    """Encodes columns of texts: the pattern's cuts are found in all bytes at once, and each distinct piece is looked up once a block.

    Ids are kept by piece in two generations, of which the older is dropped when the newer is half full.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.texts, self.most = WordCache(path), CACHE_WORDS
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.known = public_tokenizers.PATTERN == PATTERN
        space = "".join(rf"\x{{{i:x}}}" for i in range(sys.maxunicode + 1) if chr(i).isspace())
        self.double = f"[{space}]{{2}}"
        self.tests = [(LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(" ")), (WHITE, regex.compile(r"\s"))]
        self.kinds = np.zeros(sys.maxunicode + 1, dtype=np.uint8)  # 0: not looked at yet
        self.ascii = np.append(self.kinds_of(np.arange(128)), np.zeros(128, dtype=np.uint8))
        model, mark = self.texts.model, self.texts.letters[255]
        # Byte 255 is in no UTF-8; if it is in no longer token either, nothing merges across it.
        apart = not (model.dropout or model.ignore_merges) and [t for t in self.texts.tok.get_vocab() if mark in t] == [mark]
        self.mark = self.texts.tok.token_to_id(mark) if apart else None
        self.plain = Tokenizer(model)

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        for p in np.unique(points[self.kinds[points] == 0]).tolist():
            self.kinds[p] = next((kind for kind, test in self.tests if test.match(chr(p))), OTHER)
        return self.kinds[points]

    def starts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pattern begins a piece in UTF-8 in which white space never meets; ends: of the texts (ascending)."""
        kind = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            point = data[lead].astype(np.int64)
            more = 1 + (point >= 0xE0) + (point >= 0xF0)
            point &= 0x3F >> more
            for k in (1, 2, 3):
                has = np.flatnonzero(more >= k)
                point[has] = point[has] << 6 | data[lead[has] + k] & 0x3F
            kind[lead] = self.kinds_of(point)
            for k in (1, 2, 3):
                has = lead[more >= k]
                kind[has + k] = kind[has]
        cut = np.ones(len(data) + 1, dtype=bool)
        inner = cut[1:-1]
        inner[:] = kind[1:] != kind[:-1]
        inner |= kind[1:] == WHITE
        inner &= kind[:-1] != SPACE
        inner &= (data[1:] & 0xC0) != 0x80
        cut[ends] = True
        # 's, 't, 'm, 'd, 're, 've and 'll are pieces where a piece begins with the apostrophe.
        at = np.flatnonzero(data == ord("'"))
        at = at[cut[at]]
        last = ends[np.searchsorted(ends, at, side="right")]
        a, b = (np.where(at + k < last, data[np.minimum(at + k, len(data) - 1)], 0) for k in (1, 2))
        two = np.isin(a, list(b"stmd"))
        three = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cut[at[two | three] + 1] = False
        cut[at[two] + 2] = True
        cut[at[three] + 3] = True
        return cut[:-1]

    def merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece."""
        if self.mark is None:
            return [self.texts._merge(p) for p in pieces]
        cuts = range(0, len(pieces), TOGETHER)
        joined = ("\udcff".join([*pieces[a : a + TOGETHER], ""]) for a in cuts)  # the escape of byte 255
        spelt = [j.encode("utf-8", "surrogateescape").decode("latin-1").translate(self.texts.letters) for j in joined]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.plain.encode_batch_fast(spelt, add_special_tokens=False)), dtype="<u4")
        ends = np.flatnonzero(ids == self.mark)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(4 * ends[:-1] + 4).tolist()], (4 * ends).tolist(), strict=True)] if pieces else []

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        if len(self.now) > self.most // 2:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        out = list(map(now.get, pieces))
        lacking = [i for i, ids in enumerate(out) if ids is None]
        older = [before.get(pieces[i]) for i in lacking]
        new = iter(self.merged([pieces[i] for i, ids in zip(lacking, older, strict=True) if ids is None]))
        for i, ids in zip(lacking, older, strict=True):
            out[i] = ids = next(new) if ids is None else ids
            if len(pieces[i]) <= LONGEST:
                now[pieces[i]] = ids
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end_id`` after it; how many each has); null is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.double if self.known else "")
        for special in self.texts.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        low, offsets = int(offsets[0]), offsets - offsets[0]
        data = data.slice(low, int(offsets[-1])) if offsets[-1] else pa.py_buffer(b"")
        cut = self.starts(np.frombuffer(data, dtype=np.uint8), offsets[1:])
        whole = [i for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist() if offsets[i + 1] > offsets[i]]
        for i in whole:
            cut[offsets[i] + 1 : offsets[i + 1]] = False
        at = np.flatnonzero(cut)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, offsets[-1]).astype(np.int32)), data)
        first = np.searchsorted(at, offsets)
        if whole:
            own = np.zeros(len(at), dtype=bool)
            own[first[whole]] = True
            pieces = pc.if_else(own, None, pieces)
        coded = pieces.dictionary_encode()
        index = coded.indices.fill_null(-1).to_numpy().copy()
        ids = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        index[first[whole]] = len(ids) + np.arange(len(whole))
        ids += self.texts.encode([texts[i].as_py() for i in whole])
        ids.append(np.array([end_id], dtype="<u4").tobytes())
        index = np.insert(index, first[1:], len(ids) - 1)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        sizes = size[index]
        ends = np.cumsum(sizes)
        # In 32 bits unless one long text needs more: these are the largest arrays here.
        wide = np.int64 if max(size.sum(), sizes.sum()) >= 1 << 31 else np.int32
        at = np.repeat(((np.cumsum(size) - size)[index] - (ends - sizes)).astype(wide), sizes)
        at += np.arange(len(at), dtype=wide)
        return np.frombuffer(b"".join(ids), dtype="<u4")[at], np.diff(ends[first[1:] + np.arange(len(texts))], prepend=0)


def column_blocks(column: pa.Array, most: int = 4_000_000):
    """(first row, slice) of a column of texts; a slice is of at most ``most`` bytes, or one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(column):
        past = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + most, side="right")))
        yield first, column.slice(first, past - first)
        first = past


def text_blocks(batch, text: str = "text", chars: int = 1_000_000):
    """Slices of an Arrow batch of bounded text size (or one text), as (first row, texts); null is empty."""
    texts, first, size = [], 0, 0
    for i, value in enumerate(batch.column(batch.schema.get_field_index(text))):
        value = value.as_py() or ""
        texts.append(value)
        size += len(value)
        if size >= chars:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


_WORKER: dict[str, WordCache] = {}
_BLOCKS: dict[str, BlockEncoder] = {}


def worker_cache(path: str, most: int = CACHE_WORDS) -> WordCache:
    """One cache for each Python worker and tokenizer file, of at most about ``most`` words."""
    if path not in _WORKER:
        _WORKER[path] = WordCache(path)
    _WORKER[path].most = most
    return _WORKER[path]


def worker_blocks(path: str) -> BlockEncoder:
    """One encoder of columns for each Python worker and tokenizer file."""
    if path not in _BLOCKS:
        _BLOCKS[path] = BlockEncoder(path)
    return _BLOCKS[path]


def forget() -> None:
    """Frees what earlier stages left in this Python worker, and returns it to the system."""
    import ctypes
    import gc

    _WORKER.clear()
    _BLOCKS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
