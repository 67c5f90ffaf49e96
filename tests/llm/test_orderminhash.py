"""Operator 1 against Order MinHash in plain Python, with the same hashes."""

import numpy as np
import pytest
import regex
import xxhash

from tessera.llm import orderminhash as omh

M, K = 64, 3


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def hash_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64((v & ((1 << 64) - 1)).to_bytes(8, "little"), seed=seed & ((1 << 64) - 1)).intdigest()
    return signed(seed)


def tokens_of(text, token=12):
    ideographs = "⺀-鿿가-힣豈-﫿\U00020000-\U0003ffff"
    letter, cut = rf"[^\s{ideographs}]", r"[aeiouyAEIOUY0-4\p{P}]"
    pattern = rf"[!-~]{{1,{token}}}+(?!\S)|{letter}{{1,{token}}}+(?!\S)|[{ideographs}]|{letter}{{3,{token + 3}}}?(?<={cut})|{letter}{{1,{token + 4}}}"
    return regex.findall(pattern.replace(r"\s", " \t\n\x0b\f\r").replace(r"\S", "[^ \t\n\x0b\f\r]"), text)


def fingerprint(text):
    hashes = [signed(xxhash.xxh64(t.encode(), seed=42).intdigest()) for t in tokens_of(text)]
    high = ~omh.POSITION & (omh.RANGE - 1)
    count = max(len(hashes) - (K - 1), min(len(hashes), 1))
    kmers = [(hash_longs(hashes[i : i + K]) & high, i) for i in range(count)]
    seen, numbered = {}, []
    for kmer, at in kmers:  # in text order: the first occurrence is number 0
        seen[kmer] = seen.get(kmer, -1) + 1
        first = xxhash.xxh64(kmer.to_bytes(8, "little"), seed=42).intdigest()
        again = xxhash.xxh64(seen[kmer].to_bytes(4, "little"), seed=first).intdigest()
        numbered.append((again & high if seen[kmer] else kmer, at))
    numbered.sort()
    if not numbered:
        return "-" * 8 * M
    out = []
    for j in range(M):
        at = sum((h | p) < j * (omh.RANGE // M) for h, p in numbered)
        picked = [numbered[(at + e) % len(numbered)] for e in range(omh.ELEMENTS)]
        out.append(f"{hash_longs([h for _, h in sorted((p, h) for h, p in picked)]) & 0xFFFFFFFF:08x}")
    return "".join(out)


TEXTS = ["", " \t", "one", "one two", "a b c d", "the cat and the cat and the cat sat", "Wort " * 40, "x" * 500, "日本語の文章 と words", "un mot très très long anticonstitutionnellement, là."]


def test_fingerprints_equal_plain_python(spark):
    rng = np.random.default_rng(1)
    texts = [*TEXTS, *(" ".join("".join(rng.choice(list("abcde"), int(rng.integers(1, 20)))) for _ in range(n)) for n in (5, 60, 300))]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in omh.order_minhash(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3).collect()}
    for i, text in rows:
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        mine, edited, following = fingerprint(text), fingerprint(text[: len(text) - cut] + after[:cut]), fingerprint(after)
        like = lambda a, b: sum(a[8 * j : 8 * j + 8] == b[8 * j : 8 * j + 8] for j in range(M)) / M
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (mine, edited), i
        assert (got[i]["near_edited"], got[i]["near_next"]) == (like(mine, edited), like(mine, following)), i


@pytest.mark.parametrize("spaced", [True, False])
def test_one_insertion_leaves_texts_alike(spark, spaced):
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1500))
    text = " ".join(text[i : i + 6] for i in range(0, 1500, 6)) if spaced else text
    rows = [(0, text), (1, "Q" + text), (2, "日本" * 20 + text)]
    got = {r["doc_id"]: r for r in omh.order_minhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["near_next"] > 0.8
