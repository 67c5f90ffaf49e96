"""Kernels: exact round trips and brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import htmltext, neardup, packing, quality, simple8b
from tessera.llm.tokens import BlockEncoder, WordCache, column_blocks, tokenizer_path

ODD = ["", " ", "  a  b \n\n c", "\n", "a\n b", "a\n\tb\x1c\x1d c\x85d", "don't  we'll  x　 y", "<|endoftext|> hi", "日本語 テキスト１２ 3", "a \n", "x\r\n y\r\n", "\x00\x01 \x7f", "😀 😀😀\n 👩", "word " * 5000]


def test_word_cache_equals_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\tab1.é'  \x1c\r#s$") for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    tok = Tokenizer.from_file(tokenizer_path())
    for text, ids in zip(texts, WordCache(tokenizer_path()).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_block_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(2)
    bits = ["'s", "'t", "'re", "'ve", "'ll", "'", " ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "street", "é", "日本", "\u0301", "😀", "१", "½", "7", ".", ",", "***", "ÿ", "\x00", "<|endoftext|>"]
    texts = [None, *ODD, "'s" * 500, "ab, " * 2000, *("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000))]
    tok, encoder = Tokenizer.from_file(tokenizer_path()), BlockEncoder(tokenizer_path())
    encoder.most = 300  # generations go by
    for kind in (pa.string(), pa.large_string()):
        column, done = pa.array(["left out", *texts], kind).slice(1), 0
        for first, part in column_blocks(column, most=9_000):
            assert first == done and (len(part) == 1 or sum(len((t or "").encode()) for t in part.to_pylist()) <= 9_000)
            done += len(part)
            ids, each = encoder.encode(part, 7)
            for text, got in zip(part.to_pylist(), np.split(ids, np.cumsum(each)), strict=False):
                assert got.tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, 7], repr(text)
        assert done == len(texts)
    # Another pattern, or no byte that stands apart: text by text, piece by piece.
    expected = encoder.encode(pa.array(texts), 7)[0].tolist()
    for known in (False, True):
        other = BlockEncoder(tokenizer_path())
        other.known, other.mark = known, None
        assert other.encode(pa.array(texts), 7)[0].tolist() == expected


def test_block_encoder_merges_each_piece_once(monkeypatch):
    encoder, merged, seen = BlockEncoder(tokenizer_path()), BlockEncoder.merged, []
    monkeypatch.setattr(BlockEncoder, "merged", lambda self, pieces: seen.extend(pieces) or merged(self, pieces))
    encoder.encode(pa.array(["one two, two. two!\ntwo two; one", "one two's"]), 0)
    encoder.encode(pa.array(["one two. two\none two,"]), 0)
    assert sorted(seen) == sorted(["one", " two", ",", ".", "!", "\n", "two", ";", " one", "'s"])


def test_simple8b_words_are_greedy():
    rng = np.random.default_rng(8)
    for n, bits in [(1, 1), (300, 16), (300, 61), (700, 9)]:
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64) >> rng.integers(0, bits, n).astype(np.uint64)
        ids[: n // 3] = 0
        expected, starts = [], []
        for a in range(0, n, simple8b.RUN):
            run = ids[a : a + simple8b.RUN].tolist()
            starts.append(len(expected))
            while run:
                sel = next((s for s in range(1, 16) if all(v < 1 << int(simple8b.BITS[s]) for v in run[: simple8b.COUNTS[s]])), 0)
                k = int(simple8b.COUNTS[sel])
                expected += [0, run[0]] if sel == 0 else [sel << 60 | sum(v << i * int(simple8b.BITS[sel]) for i, v in enumerate(run[:k]))]
                run = run[k:]
        words, offsets = simple8b.pack(ids)
        assert words.tolist() == expected and offsets.tolist() == starts


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("top", [1, 2, 200, 50_257, 1 << 62])
def test_simple8b_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    words, offsets = simple8b.pack(ids)
    assert (simple8b.unpack(words, offsets, n) == ids).all()


def test_best_windows_are_least_cost():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 40))
        at, cost = np.cumsum(rng.integers(1, 9, n)).tolist(), rng.integers(0, 5, n).tolist()
        pad = lambda size: 0 if size in (8, 16) else 16 - size
        places, least = [0, *at], [0] + [10**9] * n
        for j in range(1, n + 1):
            for i in range(j):
                if (size := places[j] - places[i]) <= 16:
                    least[j] = min(least[j], least[i] + pad(size) + cost[j - 1] + 3)
        ends = packing.best_windows(at, cost, 16, 3)
        total = sum(pad(b - a) + cost[at.index(b)] + 3 for a, b in zip([0, *ends], ends, strict=False))
        assert total == least[-1] and ends[-1] == at[-1]


def test_shingle_sets_and_signatures():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["A b\tC  d\x0be", "a B c D e"]
    sets = neardup.shingle_sets(texts, 4)
    for text, values in zip(texts, sets, strict=True):
        words = text.lower().split()
        assert len(values) == len({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    assert (sets[-1] == sets[-2]).all()
    near = np.mean([abs((neardup.signature(a) == neardup.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) for a, b in zip(sets, sets[1:], strict=False) if len(a) and len(b)])
    assert near < 0.06


def test_main_text():
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/">Menu</a></nav><div class="ad">Buy it now.</div><article><h1>Head</h1><p><b>One &amp;\n two.<br><p>Three&nbsp;four &lt;b&gt;</p><div class="comments">Nice!</div></article><footer>&copy;</footer></body></html>'
    assert htmltext.main_text(page) == "Head\nOne & two.\nThree four <b>"
    assert htmltext.main_text("") == "" and htmltext.main_text("<script>x") == ""
    plain = "<body><ul><li>Home</li></ul>" + "<p>" + "long text here. " * 20 + "</p>" + "<div>end</div>"
    assert htmltext.main_text(plain).startswith("long text here.")


def test_main_text_keeps_short_lines_without_article():
    long = "long text here. " * 20
    page = f"<body><ul><li>Home</li></ul><div><h1>Title</h1><p>{long}</p><h2>List</h2><p>{long}</p><p>The end.</p></div><div>imprint</div></body>"
    assert htmltext.main_text(page) == "\n".join(["Title", long.strip(), "List", long.strip(), "The end."])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content has-sidebar"><p>' + "word " * 60 + "</p></div>", ("word " * 60).strip()),
        ('<article class="post comments-open"><p>Hi there</p></article>', "Hi there"),
        ('<main class="with-sidebar"><p>Hi</p></main>', "Hi"),
        ('<article><p class="related-work">Work</p><p>x</p></article>', "Work\nx"),
        ("".join(f"<p>short par {i}</p>" for i in range(30)), "\n".join(f"short par {i}" for i in range(30))),
        ("<ul>" + "".join(f"<li><a href=/x>menu item number {i}</a></li>" for i in range(40)) + "</ul><p>" + "text " * 50 + "</p>", ("text " * 50).strip()),
        ("<article><p title=it's>a</p><a title='x > y' b=\"1\">c</a></article>", "a\nc"),
        ('<article><h1>T</h1><p>x</p><div class="ad">buy</div><div class="comment-list"><p>' + "c " * 99 + "</p></div><p>y</p></article><footer>f</footer>", "T\nx\ny"),
        ('<div class="sidebar"><article><p>in</p></article></div>', "in"),
        ('<div class="widget"><p>' + "only text " * 30 + "</p></div>", ("only text " * 30).strip()),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert htmltext.main_text(page) == text


def brute_line_blocks(weights, width, threshold):
    """Every line that a run of windows over the threshold covers, less the short ones at each end that only a window reached."""
    n = len(weights)
    over = [sum(weights[i : i + width]) > threshold or weights[i] > threshold for i in range(n)]
    spans, i = [], 0
    while i < n:
        if sum(weights[i : i + width]) <= threshold:
            i += 1
            continue
        j = i
        while j < n and over[j]:
            j += 1
        a, b = i, min(n, j + width - 1)
        i = max(j, b)
        head = [k for k in range(a, min(b, a + width - 1))]
        while head and weights[head[0]] < threshold / 2:
            a = head.pop(0) + 1
        tail = [k for k in range(max(a, b - width + 1), b)]
        while tail and weights[tail[-1]] < threshold / 2:
            b = tail.pop()
        if a < b:
            spans.append((a, b))
    return spans


def test_line_blocks_equal_the_definition():
    rng = np.random.default_rng(5)
    for _ in range(300):
        weights = (rng.integers(0, 120, int(rng.integers(0, 40))) * (rng.random() < rng.random(1)[0] + 0.4)).tolist()
        width = int(rng.integers(1, 5))
        assert htmltext.line_blocks(weights, width, 86) == brute_line_blocks(weights, width, 86)


def test_windows_alone_find_the_articles():
    """The given pages without their article elements: the text is the same on nearly all."""
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    bare = [re.sub(r"<(/?)article[^>]*>", r"<\1div>", p or "") for p in pages]
    assert np.mean([htmltext.main_text(p or "") == htmltext.main_text(b) for p, b in zip(pages, bare, strict=True)]) > 0.98


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.choice(np.frombuffer(b"abcXYZ  \n\tefg\xc3", dtype=np.uint8), 5000).astype(np.uint8)
    whole = neardup.word_hashes(data)
    monkeypatch.setattr(neardup, "CHUNK", 64)
    monkeypatch.setattr(neardup, "_POWERS", [])
    parts = neardup.word_hashes(data)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and len(parts[0]) == len(bytes(data).split())


def test_a_long_text_takes_bounded_memory():
    import resource

    text = "the quick brown fox jumps, over 13 lazy dogs. " * 1_100_000  # 50 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    features, counts = quality.passage_features([text])
    assert counts.tolist() == [len(features)] and len(features) == -(-len(text) // quality.PASSAGE)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_quality_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality.WIDTH)) for k in (1, 3, 2)]
    y, w = np.array([0.0, 1.0, 1.0]), np.ones(3)
    p = {k: v.astype(np.float64) for k, v in quality.fit(bags, y, w, epochs=1).items()}
    x, counts = np.concatenate(bags), np.array([1, 3, 2])
    got = quality.gradients(p, quality.forward(p, x, counts), y, w)

    def loss(q):
        s = quality.forward(q, x, counts)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k in ("W", "V", "U", "w", "c"):
        at = tuple(int(rng.integers(n)) for n in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert got[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_part_counts_bound_the_overlap():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64) * np.uint64(2))
    a, b = values[:600], values[300:]
    unpack = lambda packed: [(x >> (neardup.FIELD * i)) & ((1 << neardup.FIELD) - 1) for x in packed for i in range(3)]
    x, y = unpack(neardup.part_counts(a)), unpack(neardup.part_counts(b))
    assert sum(x) == len(a) and sum(y) == len(b)
    assert sum(map(min, x, y)) >= len(np.intersect1d(a, b))
