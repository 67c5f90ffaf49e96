"""The deduplication engine against sequential rules and hand-made fixtures."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import SemanticIndex, Strategy, TableEncoder
from tessera.operators import components, greedy, similarity
from tessera.operators.diversify import candidate_limit, diversify
from tessera.sources import tables
from tessera.sources.tables import POS

UNIT = {"a": [1.0, 0.0], "a2": [0.96, 0.28], "b": [0.0, 1.0], "zero": [0.0, 0.0], "far": [-1.0, 0.0]}


def texts(df, column="text"):
    return [r[column] for r in df.orderBy(POS).collect()]


def test_self_dedup_exact_and_semantic(spark):
    index = SemanticIndex.fit(["a", "a", "a2", "b", "zero"], encoder=TableEncoder(UNIT), spark=spark)
    result = index.self_deduplicate(0.9)
    assert texts(result.selected) == ["a", "b", "zero"]
    assert result.duplicate_ratio == pytest.approx(0.4)
    assert result.exact_duplicate_ratio == pytest.approx(0.2)
    rows = {r[POS]: r for r in result.filtered.collect()}
    assert rows[1]["exact"] and [d["record"]["text"] for d in rows[1]["duplicates"]] == ["a"]
    assert not rows[2]["exact"] and [d["record"]["text"] for d in rows[2]["duplicates"]] == ["a", "a"]


def test_two_hop_rule(spark):
    """a-b-c is a path: c resembles only b, yet c's list meets that of a."""
    angle = lambda d: [np.cos(np.radians(d)), np.sin(np.radians(d))]
    table = {"a": angle(0), "b": angle(20), "c": angle(40)}
    result = SemanticIndex.fit(["a", "b", "c"], encoder=TableEncoder(table), spark=spark).self_deduplicate(0.93)
    assert texts(result.selected) == ["a"]
    # c names only b, which was dropped too: no kept record lists it.
    assert [d["record"]["text"] for r in result.selected_with_duplicates.collect() for d in r["duplicates"]] == ["b"]


def sequential(lists):
    seen, lost = set(), set()
    for i in sorted(lists):
        if lists[i] & seen:
            lost.add(i)
        else:
            seen |= lists[i]
    return lost


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 12), st.sets(st.integers(0, 12), min_size=1, max_size=4), min_size=1, max_size=12))
def test_greedy_walk_equals_the_sequential_rule(spark, lists):
    edges = spark.createDataFrame([(i, j) for i, l in lists.items() for j in l], "src long, dst long")
    assert {r["src"] for r in greedy.dropped_items(edges).collect()} == sequential(lists)


@pytest.mark.parametrize("most", [0, 12])
def test_greedy_components_and_rounds_equal_the_sequential_rule(spark, most):
    rng = np.random.default_rng(5)
    lists = {i: {i, *(int(x) for x in rng.integers(i // 20 * 20, i // 20 * 20 + 20, i // 20))} for i in range(120)}
    edges = spark.createDataFrame([(i, j) for i, l in lists.items() for j in l], "src long, dst long")
    assert {r["src"] for r in greedy.dropped_items(edges, most).collect()} == sequential(lists)


@pytest.mark.parametrize(("most", "early"), [(12, 0), (0, 1)])
def test_greedy_early_rounds_leave_the_rest_to_components(spark, most, early):
    rng = np.random.default_rng(6)
    lists = {i: {i, *(int(x) for x in rng.integers(i // 20 * 20, i // 20 * 20 + 20, i // 20))} for i in range(120)}
    edges = spark.createDataFrame([(i, j) for i, l in lists.items() for j in l], "src long, dst long")
    assert {r["src"] for r in greedy.dropped_items(edges, most, early).collect()} == sequential(lists)


def test_components_tell_many_links_apart(spark):
    """The sum of so many hashes would not fit a long."""
    links = spark.range(40_000_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    n, seen = components.state(links)
    assert n == 40_000_000 and (n, seen) != components.state(links.withColumn("v", F.col("v") + (F.col("u") == 7).cast("long")))


def test_pairs_are_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    named = ["a x", "a y", "a2 x", "a2 y", "a2 x", "b x", "b x", "zero x", "far x"]
    rows = [{"text": t, "tag": g} for t, g in map(str.split, named)]

    def all_of():
        result = SemanticIndex.fit(rows, ["text"], encoder=TableEncoder(UNIT), spark=spark).self_deduplicate(0.9)
        raised = result.rethreshold(0.97)
        pairs = [sorted(map(tuple, r.pairs.select(POS, "dup_pos", F.round("score", 6), "exact").collect())) for r in (result, raised)]
        lists = sorted((r["text"], [d["record"]["tag"] for d in r["duplicates"]]) for r in result.selected_with_duplicates.collect())
        return pairs, lists, sorted(map(tuple, raised.decisions.select(POS, "status").collect()))

    once = all_of()
    assert [(p, d) for p, d, _, _ in once[0][0]] == [(1, 0), (2, 0), (2, 1), (2, 3), (3, 2), (3, 4), (4, 2), (4, 3), (6, 5)]
    monkeypatch.setattr(tables, "FEW", -1)
    assert all_of() == once


def test_greedy_walk_of_a_long_chain(spark):
    lists = {i: {i, max(0, i - 1), min(1999, i + 1)} for i in range(2000)}
    edges = spark.createDataFrame([(i, j) for i, l in lists.items() for j in l], "src long, dst long").repartition(3)
    assert {r["src"] for r in greedy.dropped_items(edges).collect()} == sequential(lists)


def test_cross_dedup_judges_rows_alone(spark):
    index = SemanticIndex.fit(["a", "b"], encoder=TableEncoder(UNIT), spark=spark)
    result = index.deduplicate(["a", "a2", "far", "far"], 0.9)
    assert texts(result.selected) == ["far", "far"]
    assert {r[POS]: r["status"] for r in result.decisions.collect()} == {0: "exact", 1: "semantic", 2: "selected", 3: "selected"}


def test_tabs_become_spaces(spark):
    table = {"x\ty": [1.0, 0.0]}
    result = SemanticIndex.fit(["x\ty"], encoder=TableEncoder(table), spark=spark).self_deduplicate()
    assert texts(result.selected) == ["x y"]


def test_columns_and_payload(spark):
    rows = [{"id": 1, "text": "a", "tags": ["x"]}, {"id": 2, "text": "a", "tags": ["y"]}, {"id": 3, "text": "a2", "tags": []}]
    index = SemanticIndex.fit(rows, ["text"], encoder=TableEncoder(UNIT), spark=spark)
    result = index.self_deduplicate(0.9)
    found = result.selected_with_duplicates.collect()
    assert len(found) == 1 and sorted(d["record"]["id"] for d in found[0]["duplicates"]) == [2, 3]


def test_lists_of_duplicates_hold_the_named_fields(spark):
    """Equal dropped records count once; a dropped record's own copies are pairs where their payload differs."""
    rows = [{"id": i, "text": t, "tags": {"k": v}} for i, (t, v) in enumerate([("a", 1), ("a", 1), ("a", 2), ("a2", 3), ("a2", 4), ("b", 5)])]
    for r in rows:
        r["id"] = 1 if r["text"] == "a" else r["id"]
    rows.insert(3, dict(rows[1]))
    index = SemanticIndex.fit(rows, ["text"], encoder=TableEncoder(UNIT), spark=spark)
    result = index.self_deduplicate(0.9)
    listed = {r[POS]: r["duplicates"] for r in result.list_duplicates(["tags"]).collect()}
    # Positions 1 and 3 are equal; 4 is near, 5 is its copy and names only its own key, which was dropped.
    assert [d["record"].asDict() for d in listed[0]] == [{"tags": {"k": 1}}, {"tags": {"k": 2}}, {"tags": {"k": 3}}] and listed[6] == []
    assert {r[POS] for r in result.selected_with_duplicates.collect()} == {0, 6}
    pairs = sorted((r[POS], r["dup_pos"], r["exact"]) for r in result.pairs.collect())
    assert [p for p in pairs if p[0] in (4, 5)] == [(4, 0, False), (4, 1, False), (4, 2, False), (4, 3, False), (4, 5, False), (5, 4, True)]
    assert len(pairs) == 6 + 9
    assert "to_json" not in result.links._jdf.queryExecution().optimizedPlan().toString()


def test_null_and_empty_keys_differ(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, None)], "n long, text string")
    from tessera.operators.exact import with_groups

    got = {r["n"]: r["group_pos"] for r in with_groups(df.withColumn(POS, df.n), ["text"]).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_rethreshold(spark):
    index = SemanticIndex.fit(["a", "a2", "b"], encoder=TableEncoder(UNIT), spark=spark)
    result = index.self_deduplicate(0.9)
    raised = result.rethreshold(0.99)
    assert texts(raised.selected) == ["a", "a2", "b"] and texts(result.selected) == ["a", "b"]
    with pytest.raises(ValueError):
        raised.rethreshold(0.5)
    least = result.least_similar(1).collect()
    assert len(least) == 1 and least[0]["score"] == pytest.approx(0.96)


def test_first_embedding_of_a_key_counts(spark):
    vectors = np.arange(1, 5, dtype=np.float32).reshape(4, 1)
    index = SemanticIndex.fit_embeddings(["oak", "elm", "oak", "ash"], vectors, spark=spark)
    assert sorted((r["item"], r["vector"][0]) for r in index.vectors.collect()) == [(0, 1.0), (1, 2.0), (3, 4.0)]


def test_errors(spark):
    with pytest.raises(ValueError, match="Number of embeddings"):
        SemanticIndex.fit_embeddings(["a"] * 3, np.zeros((2, 2)), spark=spark)
    with pytest.raises(ValueError, match="2D"):
        SemanticIndex.fit_embeddings(["a"], np.zeros(2), spark=spark)
    with pytest.raises(ValueError):
        SemanticIndex.fit([], spark=spark)
    with pytest.raises(ValueError):
        SemanticIndex.fit([{"text": "a"}], spark=spark)
    index = SemanticIndex.fit([{"text": "a"}], ["text"], encoder=TableEncoder(UNIT), spark=spark)
    with pytest.raises(ValueError):
        index.deduplicate(["a"])
    with pytest.raises(ValueError):
        index.deduplicate([{"text": "a"}, "a"])
    for share in (-0.1, 1.1):
        with pytest.raises(ValueError):
            index.self_filter_outliers(share)


def test_outliers_and_ranks(spark):
    rng = np.random.default_rng(1)
    data = np.vstack([np.array([1.0, 0.0]) + rng.normal(0, 0.05, (9, 2)), [[-1.0, 0.2]]])
    index = SemanticIndex.fit_embeddings([f"t{i}" for i in range(10)], data, spark=spark)
    result = index.self_filter_outliers(0.1)
    assert [r["text"] for r in result.filtered.collect()] == ["t9"]
    assert result.filter_ratio == pytest.approx(0.1)
    assert index.self_filter_outliers(0.0).filtered.count() == 0
    assert index.self_filter_outliers(1.0).selected.count() == 0


def test_single_record_has_no_score(spark):
    index = SemanticIndex.fit(["a"], encoder=TableEncoder(UNIT), spark=spark)
    assert index._self_ranking.first()["score"] is None


def test_representatives(spark):
    index = SemanticIndex.fit(["a", "a2", "b", "far"], encoder=TableEncoder(UNIT), spark=spark)
    found = index.self_find_representative(2, candidate_limit=3)
    assert found.selected.count() == 2 and found.filtered.count() == 1
    assert index.self_find_representative(2, candidate_limit=0).rows.count() == 0
    assert index.find_representative(["a", "b"], 1).selected.count() == 1


@pytest.mark.parametrize(("diversity", "picks"), [(0.0, [0, 1]), (1.0, [0, 2])])
def test_mmr_anchor(diversity, picks):
    assert diversify(np.array([[1, 0], [0.5, 0.5], [0, 1]]), np.array([3, 2, 1]), 2, "mmr", diversity)[0] == picks


@pytest.mark.parametrize("strategy", list(Strategy))
def test_strategies(strategy):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(20, 5))
    picks, gains = diversify(vectors, rng.random(20), 7, strategy, 0.5)
    assert len(set(picks)) == 7 == len(gains)
    order = np.argsort(-np.arange(20.0)[::-1], kind="stable")[:3].tolist()
    assert diversify(vectors, np.arange(20.0)[::-1], 3, strategy, 0.0)[0] == order


def test_candidate_limit():
    assert [candidate_limit(*x) for x in ((1000, 10), (50, 10), (20000, 10), (100, 50), (50000, 3000))] == [100, 50, 1000, 100, 1000]


def test_search_methods_agree(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "item long, vector array<double>")
    key = lambda rows: sorted((r["src"], r["dst"], round(r["score"], 9)) for r in rows)
    one = key(similarity.search(df, df, 5, None, True).collect())
    two = key(similarity.search(df, df, 5, None, True, max_broadcast=0).collect())
    assert one == two and len(one) == 300
    close = df.union(spark.createDataFrame([(100 + i, (v + 0.001).tolist()) for i, v in enumerate(data)], df.schema))
    exact = key(similarity.search(close, close, 100, 0.999, True).collect())
    fuzzy = key(similarity.search(close, close, 100, 0.999, True, "lsh").collect())
    assert set(fuzzy) <= set(exact) and len(fuzzy) >= 0.9 * len(exact)


@pytest.mark.parametrize("threshold", [0.35, 0.7, 0.9])
def test_lsh_recall_holds_at_the_threshold(spark, threshold):
    """Pairs just above the threshold, the hardest ones, in 32 dimensions."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 400, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = threshold + 0.005
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "item long, vector array<double>")
    right = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(c * a + np.sqrt(1 - c * c) * b)], left.schema)
    found = {(r["src"], r["dst"]) for r in similarity.search(left, right, None, threshold, method="lsh").collect()}
    assert sum((i, 1000 + i) in found for i in range(400)) >= 0.9 * 400
    assert found <= {(r["src"], r["dst"]) for r in similarity.search(left, right, None, threshold).collect()}


def test_search_options(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1])], "item long, vector array<double>")
    index = SemanticIndex.fit(["a", "a2"], encoder=TableEncoder(UNIT), spark=spark, search="lsh", bands=30, bits=4)
    assert texts(index.self_deduplicate(0.9).selected) == ["a"]
    assert similarity.search(df, df, None, 0.9, True, "lsh", bands=40, bits=2).count() == 2
    with pytest.raises(ValueError):
        similarity.search(df, df, None, 0.9, bands=3)


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_wide_search_equals_brute_force_over_any_number_of_slices(spark, most):
    """Sparse and dense counts in 300 dimensions, near copies and a zero vector: the bound from fewer directions drops nothing."""
    rng = np.random.default_rng(4)
    data = rng.poisson(0.05, (50, 300)) + np.where(np.arange(50)[:, None] % 2, rng.normal(size=(50, 300)), 0)
    data = np.vstack([data, data * 1.5 + (rng.random(data.shape) < 0.01), np.zeros((1, 300))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "item long, vector array<double>").repartition(3)
    norms = np.linalg.norm(data, axis=1)
    cosines = data @ data.T / np.maximum(np.outer(norms, norms), 1e-12)
    assert similarity.kept_width(300, 0.9) < 300
    want = {(i, j) for i, j in zip(*np.nonzero(cosines >= 0.9), strict=True)}
    got = similarity.search(df, df, None, 0.9, max_broadcast=most).collect()
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want) > 150
    got = {r["src"]: r["score"] for r in similarity.search(df, df, 5, None, True, max_broadcast=most, means=True).collect()}
    np.fill_diagonal(cosines, -2)
    best = np.sort(cosines, axis=1)[:, -5:].mean(axis=1)
    assert [got[i] for i in range(len(data))] == pytest.approx(best.tolist())


@pytest.mark.parametrize("means", [False, True])
def test_search_in_rounds_carries_a_bounded_number_of_lists(spark, monkeypatch, means):
    """Over several slices, the lists of a round's blocks alone are handed on, and the result is that of one round."""
    data = np.random.default_rng(8).normal(size=(120, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "item long, vector array<double>").repartition(6)
    key = lambda rows: {tuple(round(x, 9) for x in r) for r in rows}
    want = key(similarity.search(df, df, 7, None, True, means=means).collect())
    for name in ("AT_ONCE", "MAX_CARRIED"):
        monkeypatch.setattr(similarity, name, 1)
    monkeypatch.setattr(similarity, "BLOCK", 4)
    carried, write = [], similarity.materialize

    def counted(rows, name, *path):
        out = write(rows, name, *path)
        if name == "best":
            carried.append(out.count())
        return out

    monkeypatch.setattr(similarity, "materialize", counted)
    found = similarity.search(df, df, 7, None, True, max_broadcast=2000, means=means).collect()
    assert key(found) == want and len(found) == (120 if means else 840)
    most = 3 * spark.sparkContext.defaultParallelism
    assert carried and max(carried) <= most < 120 // 4


def test_fitted_embeddings_are_written_once(spark, monkeypatch):
    from tessera.plans import index as plans

    written, write = [], plans.materialize
    monkeypatch.setattr(plans, "materialize", lambda rows, name: written.append((name, rows.columns)) or write(rows, name))
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], "item long, e array<float>")
    index = SemanticIndex.fit_embeddings(df, "e", ["item"], order_by="item")
    assert written == [("records", ["item", "e", "_pos", "group_pos"])]
    assert dict(index.vectors.dtypes) == {"item": "bigint", "vector": "array<double>"} and index.vectors.count() == 3


def test_lsh_with_full_buckets_compares_blocks_instead(spark, monkeypatch):
    """Bands of one bit would join nearly all pairs in half of the bands each; the pairs found are the same."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 8)))], "item long, vector array<double>")
    signs = similarity.Signs(0.3, bands=2, bits=2)
    rows = similarity.lsh_rows(df, signs)
    want = {(r["src"], r["dst"]) for r in similarity.lsh_edges(rows, rows, 0.3, True).collect()}
    monkeypatch.setattr(similarity, "lsh_edges", None)
    found = similarity.search(df, df, None, 0.3, True, "lsh", bands=2, bits=2).collect()
    assert {(r["src"], r["dst"]) for r in found} == want
    every = similarity.search(df, df, None, 0.3, True).count()
    assert 0 < len(want) < every


def test_lsh_query_counts_a_vector_among_its_hundred(spark, tmp_path):
    from tessera.plans.queries import lsh_edges_embeddings

    spark.createDataFrame([(i, [1.0, i / 1000], 0) for i in range(130)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r["count"] for r in lsh_edges_embeddings(spark, str(tmp_path)).groupBy("src").count().collect()} == {99}


def test_cap_keeps_the_best(spark):
    df = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(130)], "item long, vector array<double>")
    assert similarity.search(df, df, 100, 0.5).groupBy("src").count().agg({"count": "max"}).first()[0] == 100


def test_no_cap_keeps_all_links(spark):
    vectors = {f"t{i}": [1.0, i / 1000] for i in range(130)}
    index = SemanticIndex.fit(list(vectors), encoder=TableEncoder(vectors), spark=spark)
    whole = index.self_deduplicate(0.9, cap=None)
    assert whole.selected.count() == 1
    assert whole.pairs.groupBy(POS).count().agg({"count": "min"}).first()[0] == 129
    assert index.self_deduplicate(0.9).pairs.groupBy(POS).count().agg({"count": "max"}).first()[0] <= 100


def test_stream(spark, tmp_path):
    from tessera.streaming.dedup import deduplicate_stream

    index = SemanticIndex.fit([{"text": "a"}], ["text"], encoder=TableEncoder(UNIT), spark=spark)
    spark.createDataFrame([(0, "a"), (1, "b")], "n long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, text string").parquet(str(tmp_path / "in"))
    deduplicate_stream(stream, index, f"file://{tmp_path}/out", f"file://{tmp_path}/state", "n").awaitTermination(90)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b"]
