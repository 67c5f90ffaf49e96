"""Operators on small tables: nulls, empty and long texts, ties, empty tables, extra columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, htmltext, neardup, orderminhash, packing, perspectives, quality, simple8b, urlfilter
from tessera.llm.tokens import tokenizer_path

LONG = "one two three four five six seven eight nine ten " * 3000
ROWS = [(0, "the quick brown fox jumps over the lazy dog and runs away home"), (1, "the quick brown fox jumps over the lazy dog and runs away home"), (2, None), (3, ""), (4, LONG), (4, LONG), (None, "a text without an id"), (7, "x"), (9, "  \n\t ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n", "k", 1, "w") for i, t in ROWS], "doc_id long, text string, node string, key string, row int, word string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def ids_of(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_order_minhash(docs, none):
    got = orderminhash.order_minhash(docs, buckets=3).collect()
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"] and by_id[0]["near_next"] == 1.0
    ordered = order([(i, t or "") for i, t in ROWS])
    expected = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        cut = len(text) // 4
        expected.append((i, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(expected, key=key) == sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key)
    assert all(0 <= r["near_edited"] <= 1 for r in got)
    assert orderminhash.order_minhash(none).count() == 0


def test_order_matters_to_fingerprints(spark):
    rows = [(0, " ".join(f"w{i}" for i in range(200))), (1, " ".join(f"w{i}" for i in [*range(100, 200), *range(100)])), (2, " ".join(["w"] * 50))]
    got = {r["doc_id"]: r for r in orderminhash.order_minhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["near_next"] < 0.75 and got[0]["near_edited"] > 0.2


def test_simple8b(docs, none):
    got = simple8b.simple8b_corpus(docs).collect()
    start, expected = 0, []
    for i, text in order(ROWS):
        ids = ids_of(text, 0)
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in got) == [(*e[1:], e[0]) for e in expected]
    assert simple8b.simple8b_corpus(none).count() == 0


def test_simple8b_blocks(docs):
    """Documents of one slice go to several blocks, and slices to one."""
    rows = [r for r in simple8b.encode_documents(docs.coalesce(1), block_ids=5_000).collect() if r["n_ids"]]
    lens = {}
    for r in rows:
        assert sum(r["doc_lens"]) == r["n_ids"] and sum(r["doc_lens"][:-1]) < 5_000
        ids = simple8b.block_ids(r["words"], r["offsets"], r["n_ids"])
        for i, part in zip(r["doc_ids"], np.split(ids, np.cumsum(r["doc_lens"])), strict=False):
            lens.setdefault(i, []).append(part.tolist())
    assert len(rows) > 1 and {i: sorted(v) for i, v in lens.items()} == {i: sorted(ids_of(t, 0) for k, t in ROWS if k == i) for i, _ in ROWS}


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def test_near_duplicates(docs, none):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 4).collect()]
    assert sorted(got, key=str) == sorted(brute_components(ROWS, 4, 80), key=str)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_whole_table(spark):
    """Against brute force over all pairs that share a shingle."""
    from collections import Counter, defaultdict

    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = []
    for _, text in rows:
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    holders = defaultdict(list)
    for i, found in enumerate(sets):
        for x in found:
            holders[x].append(i)
    shared = Counter((i, j) for found in holders.values() for k, i in enumerate(found) for j in found[k + 1 :])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(i, j) for (i, j), n in shared.items() if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    for i, j in links:
        root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 4).collect()}
    assert len(links) > 50 and got == {doc: (len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


def test_near_duplicates_in_an_open_bucket(spark, monkeypatch):
    """Only the last pairing is left to find the links, in buckets dealt to many tasks; ids may be null."""
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 1)
    monkeypatch.setattr(neardup, "_TURNS", [[0]])
    monkeypatch.setattr(neardup, "SPLIT", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(k if k % 5 else None, " ".join(base[: 60 - k % 9] + [f"v{k // 9}_{i}" for i in range(8)])) for k in range(60)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows, 4, 80), key=str)


def test_near_duplicate_chain(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(words[: 100 - 3 * k] + [f"v{k}_{i}" for i in range(3)])) for k in range(12)] + [(50, "a b c"), (51, "A  B c"), (52, "a b")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()]
    assert sorted(got) == sorted(brute_components(rows, 4, 80))


def test_packing(docs, none):
    got = packing.pack_documents(docs.coalesce(1), segment=3000).collect()
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for i, text in dict(ROWS).items():
        ids = ids_of(text, 1)
        rows = sorted(pieces[(i, len(ids))], key=lambda r: r["start"])
        assert all(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in rows)
        assert sum(r["length"] for r in rows) == len(ids) * sum(1 for d, _ in ROWS if d == i)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("limit", [urlfilter.MAX_FILTER_WORDS, 0])
def test_url_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "MAX_FILTER_WORDS", limit)
    cases = {
        "http://Example.ORG/es/1?x": ("example.org", "/es/1", "example.org/es/", "block"), "https://a.example.org/en/1": ("a.example.org", "/en/1", "example.org/en/1", "block"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"), "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"), "http://x.com/de/#t": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com": ("x.com", "", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://org?q=/": ("org", "", None, "allow"), "://org/": ("org", "/", "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "r", "k") for i, u in enumerate(cases)] * 2, "page_id long, url string, rule string, key string")
    got = urlfilter.filter_urls(pages, urlfilter.rules_frame(spark)).collect()
    expected = [(i, *v) for i, v in enumerate(cases.values())] * 2
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert urlfilter.filter_urls(pages.where("false"), urlfilter.rules_frame(spark)).count() == 0
    assert urlfilter.filter_urls(pages, urlfilter.rules_frame(spark).where("false")).where("rule IS NOT NULL").count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 300 + "org/" + "x/" * 20_000), (2, "http://b.com/fr/")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in urlfilter.filter_urls(long, urlfilter.rules_frame(spark)).collect()} == {1: "org/", 2: "com/fr/"}


@pytest.mark.parametrize("limit", [urlfilter.MAX_FILTER_WORDS, 0])
def test_url_filter_of_a_long_list(spark, monkeypatch, limit):
    """Many rules, of which one fits nearly all pages."""
    monkeypatch.setattr(urlfilter, "MAX_FILTER_WORDS", limit)
    rules = spark.range(200_000).select(F.concat(F.lit("h"), "id", F.lit(".net/")).alias("rule"), F.lit("block").alias("verdict")).unionByName(urlfilter.rules_frame(spark))
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("http://x.org/"), "id").alias("url"),
    ).union(spark.range(20).selectExpr("10000 + id", "concat('https://a.h', id * 9999, '.net/q')"))
    got = urlfilter.filter_urls(pages, rules)
    assert {(r["rule"] == "org/", r["verdict"]): r["count"] for r in got.groupBy((F.col("rule") == "org/").alias("org"), "verdict").count().select(
        F.when(F.col("org"), F.lit("org/")).alias("rule"),
        "verdict",
        "count",
    ).collect()} == {(True, "allow"): 3000, (False, "block"): 20}


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<article><p>Hi</p></article>", 1), (2, None, None, 1), (2, None, "", 1), (3, "v", "<p>" + LONG * 10, 1)],
        "page_id long, url string, html string, n_chars int",
    )
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract_text(pages).collect()), key=str)
    long = (LONG * 10).strip()
    assert got == [(1, "Hi", 2), (2, "", 0), (2, "", 0), (3, long, len(long))]
    assert htmltext.extract_text(pages.where("false")).count() == 0


def test_quality(spark, docs):
    rows = [(i, f"a plain sentence number {i} about things, and it goes on." * 3 if i % 3 else f"SPAM!! {i} ### $$$ BUY!! *** " * 5) for i in range(120)]
    table = spark.createDataFrame([*rows, (None, None), (500, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_documents(table, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(120))
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in range(120) if got[i]["held_out"]]) > 0.95
    assert {r["score"] for r in quality.score_documents(docs, labels.where("false")).collect()} == {1.0}
    kept = quality.score_documents(docs.withColumnRenamed("word", "_score"), labels, keep=0.0)
    assert kept.columns == docs.withColumnRenamed("word", "_score").columns and kept.count() == len(ROWS)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "Quick brown fox, jumps over the lazy dog and RUNS away!", "x"), (2, "x", "x"), (3, None, "x"), (4, "..", "x"), (5, "quick fox jumps", "x")],
        "item_id long, text string, row string",
    )
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs, items).collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["n_items"], got[0]["contaminated"]) == (13, 11, 1, True)
    assert got[0]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and got[7]["n_hit"] == 1
    assert (got[2]["n_words"], got[2]["n_hit"], got[2]["contaminated"]) == (0, 0, False)
    near = {r["doc_id"]: r["n_items"] for r in decontam.decontaminate(docs, items, slop=1).collect()}
    assert near[0] == 2  # "quick fox jumps" lies one position off
    assert decontam.decontaminate(none, items).count() == 0 and not any(r["contaminated"] for r in decontam.decontaminate(docs, items.where("false")).collect())
    clean = decontam.clean_rows(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] or -1 for r in clean.collect()) == [-1, 2, 3, 4, 4, 9]


@pytest.mark.parametrize(("slop", "most"), [(0, decontam.MAX_BROADCAST), (1, 100)])
def test_many_windows_equal_brute_force(spark, monkeypatch, slop, most):
    """60,000 windows, frequent and rare words, exact and near places; tables broadcast or shuffled."""
    from collections import Counter, defaultdict

    monkeypatch.setattr(decontam, "MAX_BROADCAST", most)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{int(x)}" for x in rng.zipf(1.3, n) % 5000]
    items = [word(110) for _ in range(600)]
    docs = []
    for i in range(60):
        text = word(200)
        for _ in range(3):
            passage = items[int(rng.integers(600))][20:40]
            if rng.random() < 0.5:
                passage[5:5] = ["put", "in"][: int(rng.integers(1, 3))]
            at = int(rng.integers(200))
            text[at:at] = passage
        docs.append((i, " ".join(text)))
    windows = defaultdict(set)
    for i, words in enumerate(items):
        for k in range(len(words) - 9):
            windows[tuple(words[k : k + 10])].add(str(i))
    assert len(windows) > 59_000
    count = Counter(w for _, t in docs for w in t.split())
    expected = {}
    for i, text in docs:
        words, hit, named = text.split(), set(), set()
        places = defaultdict(list)
        for k, w in enumerate(words):
            places[w].append(k)
        for window, of in windows.items():
            if not all(w in places for w in window):
                continue
            _, offset, anchor = min((count[w], k, w) for k, w in enumerate(window))
            for p in places[anchor]:
                start = p - offset
                if start >= -slop and all(any(abs(q - start - k) <= slop for q in places[w]) for k, w in enumerate(window)):
                    hit.update(range(max(0, start), min(len(words), start + 10)))
                    named |= of
        expected[i] = (len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest())
    table = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.decontaminate(table, tests, slop=slop).collect()}
    assert got == expected and sum(e[1] for e in expected.values()) > 500


def test_perspectives(spark):
    rows = [(1, 0, "ann", "Hi"), (1, 1, "bob", None), (1, 2, None, "Yo"), (None, 0, "ann", "x"), (1, 70, "ann", "late <|end|>"), (2, 5, "b|>", "same"), (2, 5, "b|>", "same")]
    table = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, begin string")
    got = {(r["conv_id"], r["participant"], r["segment"]): r for r in perspectives.rotate(table).collect()}
    assert set(got) == {(1, p, 0) for p in ("ann", "bob", "unknown")} | {(None, "ann", 0), (2, "b|>", 0)}
    row = got[(1, "ann", 0)]
    assert row["rendered"] == "<|assistant|>\nHi\n<|end|>\n<|user name=bob|>\n\n<|end|>\n<|user name=unknown|>\nYo\n<|end|>\n<|assistant|>\nlate <\\|end|\\>\n<|end|>\n"
    assert [row["rendered"][s["start"] : s["end"]] for s in row["spans"]] == ["Hi\n<|end|>", "\n<|end|>", "Yo\n<|end|>", "late <\\|end|\\>\n<|end|>"] and [s["mask"] for s in row["spans"]] == [1, 0, 0, 1]
    assert got[(2, "b|>", 0)]["rendered"].count("same") == 2 and (row["n_messages"], row["n_trained"]) == (4, 2)
    assert perspectives.rotate(table.where("false")).count() == 0


def test_perspectives_bound_their_rows(spark):
    """Turns without a number, and of one number, and one very long text."""
    table = spark.createDataFrame(
        [(1, None, "a" if i % 2 else "b", f"t{i}") for i in range(300)] + [(2, 4, "a", f"{i:03}") for i in range(130)] + [(3, 0, "a", LONG * 20)],
        "conv_id long, turn long, role string, text string",
    )
    got = perspectives.rotate(table).collect()
    assert max(r["n_messages"] for r in got) == 64
    assert {c: sum(r["n_messages"] for r in got if r["conv_id"] == c and r["participant"] == "a") for c in (1, 2, 3)} == {1: 300, 2: 130, 3: 1}
    texts = [r["rendered"] for r in sorted((r for r in got if r["conv_id"] == 2), key=lambda r: r["segment"])]
    assert [t for x in texts for t in x.split("\n") if t.isdigit()] == [f"{i:03}" for i in range(130)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, source)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
    assert corpus_pipeline.run(spark, source).count() > 0


def brute_pipeline(spark, source, scores):
    """The documents that reach packing, by plain loops: scores decide the first stage."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{source}/documents.parquet").collect()]
    docs = [d for d in docs if scores[d[0]] >= 0.5]
    roots = brute_components(docs, 5, 80)
    empty = {doc for doc, text in docs if not text.split()}
    docs = [(doc, text) for (doc, text), (_, _, least) in zip(docs, roots, strict=True) if doc == least or doc in empty]
    import re

    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", t.translate({i: i + 32 for i in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{source}/benchmark.parquet").collect():
        found = words(r["text"] or "")
        windows |= {tuple(found[i : i + 10]) for i in range(max(1, len(found) - 9))} if found else set()
    sizes = {len(w) for w in windows}
    hit = lambda f: any(tuple(f[i : i + n]) in windows for n in sizes for i in range(len(f) - n + 1))
    return {doc: len(ids_of(text, 1)) for doc, text in docs if not hit(words(text))}


def test_pipeline_equals_plain_loops(spark):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{source}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    tokens = {}
    for r in corpus_pipeline.run(spark, source).collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == brute_pipeline(spark, source, scores)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A table with nulls, repeats, one very long text, and columns whose names clash with the operators' own."""
    folder = tmp_path_factory.mktemp("odd")
    long = " ".join(f"Word{i % 7919} runs, and {i % 13} more." for i in range(60_000))
    rows = [(i, f"A plain sentence number {i} about things, and it goes on and on for {i} days." if i % 3 else f"SPAM {i} ### $$$ BUY!! *** " * 5) for i in range(90)]
    rows += [(None, None), (None, ""), (None, "Two rows without an id say the very same long thing to all of us here."), (None, "Two rows without an id say the very same long thing to all of us here."), (5, "Another text of number five, which repeats an id that is taken already."), (1000, long), (1001, long)]
    table = spark.createDataFrame([(i, t, "n", "k", 1.0) for i, t in rows], "doc_id long, text string, node string, _row string, _score double")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(
        [(1, "number 7 about things, and it goes on and on for 7 days"), (2, None), (None, "")],
        "item_id long, text string",
    ).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, odd)
        assert docs.columns == ["doc_id", "text", "node", "_row", "_score"], name
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts = [t for _, t in kept["near_duplicates"]]
    assert sum(bool(t) and t.startswith("Two rows") for t in texts) <= 1 and sum(bool(t) and t.startswith("Word0") for t in texts) <= 1
    assert all(doc != 7 for doc, _ in kept["decontamination"])
    pieces = corpus_pipeline.run(spark, odd).collect()
    assert sum(r["length"] for r in pieces) == sum(len(ids_of(t, 1)) for _, t in kept["decontamination"])


def test_pipeline_on_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    near = [" ".join([*words[:-k], *(f"v{k}" for _ in range(k))]) for k in range(1, 6)]
    other = " ".join(f"z{i}" for i in range(100))
    rows = [(None, near[0], "a"), (None, near[1], "b"), (7, near[2], "c"), (7, near[3], "d"), (9, near[4], "e"), (None, other, "f"), (3, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(r["_row"] for r in got.collect())
    assert kept in (["c", "f", "g"], ["d", "f", "g"])
