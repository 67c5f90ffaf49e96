"""Registered queries of the engine's own operators and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.encoders import HashedBigramEncoder, featurize
from tessera.functions.records import dict_to_string
from tessera.operators.exact import with_groups
from tessera.plans.index import SemanticIndex
from tessera.sources.tables import POS, check_like, prepare, read, shared_folder, write


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _embeddings(spark, sf_dir) -> SemanticIndex:
    return SemanticIndex.fit_embeddings(_table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"], order_by="vec_id")


def _split_embeddings(spark, sf_dir):
    """Index of the rows not divisible by 5, and its queries: the others."""
    rows = _table(spark, sf_dir, "embeddings")
    index = SemanticIndex.fit_embeddings(rows.where("vec_id % 5 <> 0"), "embedding", ["vec_id"], order_by="vec_id", encoder=None)
    return index, rows.where("vec_id % 5 = 0")


def _documents(spark, sf_dir) -> SemanticIndex:
    return SemanticIndex.fit(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], order_by="doc_id")


def exact_dedup_documents(spark, sf_dir):
    rows = with_groups(_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").alias(POS)), ["text"])
    return rows.select("doc_id", F.col("group_pos").alias("first_id"), (F.col("doc_id") == F.col("group_pos")).alias("kept"))


def exact_dedup_multikey(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_custkey").alias(POS))
    return with_groups(rows, ["c_nationkey", "c_mktsegment"]).select("c_custkey", F.col("group_pos").alias("first_key"))


def exact_groups_documents(spark, sf_dir):
    rows = with_groups(_table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias(POS)), ["text"])
    return rows.groupBy("group_pos").agg(F.count("*").alias("copies")).where("copies > 1").withColumnRenamed("group_pos", "first_id")


def bigram_vectors(spark, sf_dir):
    rows = featurize(_table(spark, sf_dir, "documents"), "doc_id", ["text"], HashedBigramEncoder())
    return rows.select("doc_id", F.posexplode("vector").alias("bucket", "value")).where("value <> 0").select(
        "doc_id",
        F.col("bucket").cast("long").alias("bucket"),
        F.col("value").cast("long").alias("value"),
    )


def _edges(index: SemanticIndex, k, threshold, skip_self):
    found = index._search(index.vectors, k, threshold, skip_self)
    return found.select("src", "dst", F.round("score", 6).alias("score"))


def threshold_edges_embeddings(spark, sf_dir):
    return _edges(_embeddings(spark, sf_dir), 100, 0.35, False)


def topk_edges_embeddings(spark, sf_dir):
    return _edges(_embeddings(spark, sf_dir), 10, None, True)


def threshold_edges_documents(spark, sf_dir):
    return _edges(_documents(spark, sf_dir), 100, 0.9, False)


def _decisions(result, name):
    return result.decisions.select(F.col(POS).alias(name), "status")


def self_dedup_embeddings(spark, sf_dir):
    return _decisions(_embeddings(spark, sf_dir).self_deduplicate(0.35), "vec_id")


def self_dedup_documents(spark, sf_dir):
    return _decisions(_documents(spark, sf_dir).self_deduplicate(0.9), "doc_id")


def self_dedup_pairs_embeddings(spark, sf_dir):
    pairs = _embeddings(spark, sf_dir).self_deduplicate(0.35).pairs
    return pairs.select(F.col(POS).alias("vec_id"), F.col("dup_pos").alias("dup_id"), F.round("score", 6).alias("score"), "exact")


def cross_dedup_documents(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = SemanticIndex.fit(rows.where("doc_id % 5 <> 0"), ["text"], order_by="doc_id")
    return _decisions(index.deduplicate(rows.where("doc_id % 5 = 0"), 0.9, order_by="doc_id"), "doc_id")


def rank_self_embeddings(spark, sf_dir):
    return _embeddings(spark, sf_dir)._self_ranking.select(F.col(POS).alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def rank_cross_embeddings(spark, sf_dir):
    index, queries = _split_embeddings(spark, sf_dir)
    ranks, _, _ = index._ranking(queries, "vec_id", "embedding")
    return ranks.select(F.col(POS).alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def outliers_self_embeddings(spark, sf_dir):
    return _embeddings(spark, sf_dir).self_filter_outliers(0.1).filtered.select("vec_id")


def outliers_cross_embeddings(spark, sf_dir):
    index, queries = _split_embeddings(spark, sf_dir)
    return index.filter_outliers(queries, 0.1, "vec_id", "embedding").filtered.select("vec_id")


def outliers_ratios_embeddings(spark, sf_dir):
    result = _embeddings(spark, sf_dir).self_filter_outliers(0.1)
    return spark.createDataFrame([(round(result.filter_ratio, 9), round(result.selected_ratio, 9))], "filter_ratio double, selected_ratio double")


def cross_dedup_embeddings(spark, sf_dir):
    index, queries = _split_embeddings(spark, sf_dir)
    return _decisions(index.deduplicate(queries, 0.35, "vec_id", embeddings="embedding"), "vec_id")


def representative_cross_mmr_embeddings(spark, sf_dir):
    index, queries = _split_embeddings(spark, sf_dir)
    found = index.find_representative(queries, 10, order_by="vec_id", embeddings="embedding")
    return found.selected.select(F.col("pick").cast("long").alias("pick"), "vec_id")


def lsh_edges_embeddings(spark, sf_dir):
    """Bands of one bit: the candidates are then all pairs but one in 10**20."""
    index = _embeddings(spark, sf_dir)
    index.method, index.options = "lsh", {"bands": 64, "bits": 1}
    return _edges(index, 100, 0.35, False).where("src <> dst")  # a vector's own item is one of the hundred


def self_dedup_pairs_documents(spark, sf_dir):
    """All pairs of dropped documents, exact copies (score 1) included."""
    pairs = _documents(spark, sf_dir).self_deduplicate(0.9).pairs
    return pairs.select(F.col(POS).alias("doc_id"), F.col("dup_pos").alias("dup_id"), F.round("score", 6).alias("score"), "exact")


def _names(spark, sf_dir) -> list[str]:
    """The 25 nations, then the first 5 again with a tab, then the regions twice."""
    nations = [r["n_name"] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    regions = [r["r_name"] for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    return [*nations, *(f"{n}\tagain" for n in nations[:5]), *regions, *regions]


def strings_selected(spark, sf_dir):
    """Strings come back as strings, with spaces for tabs."""
    result = SemanticIndex.fit(_names(spark, sf_dir), spark=spark).self_deduplicate(0.9)
    return result.selected.select(F.col(POS).alias("pos"), "text")


def strings_filtered(spark, sf_dir):
    """The strings dropped, what they equal, and the score of exact copies."""
    result = SemanticIndex.fit(_names(spark, sf_dir), spark=spark).self_deduplicate(0.9)
    first = F.col("duplicates")[0]
    return result.filtered.select(
        F.col(POS).alias("pos"),
        "text",
        "exact",
        F.size("duplicates").cast("long").alias("n"),
        first["record"]["text"].alias("duplicate"),
        first["score"].alias("score"),
    )


def prepared_records_nation(spark, sf_dir):
    """Dictionaries of which every third lacks a key column: it is empty."""
    rows = _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    records = [{"name": r["n_name"]} if r["n_nationkey"] % 3 == 0 else {"name": r["n_name"], "region": str(r["n_regionkey"])} for r in rows]
    found, columns, _ = prepare(spark, records, ["name", "region"])
    return found.select(F.col(POS).alias("pos"), *columns)


def written_orders(spark, sf_dir):
    """The orders written as ORC and as JSON, read back and joined."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"))
    folder = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    write(rows, f"{folder}/orc", "orc")
    write(rows, f"{folder}/json", "json")
    again = read(spark, f"{folder}/json", "json").withColumnRenamed("o_custkey", "again")
    return read(spark, f"{folder}/orc", "orc").join(again, "o_orderkey").select("o_orderkey", "o_custkey", "again")


def outliers_self_documents(spark, sf_dir):
    rows = _documents(spark, sf_dir).self_filter_outliers(0.1).rows
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def _representatives(strategy):
    def query(spark, sf_dir):
        found = _embeddings(spark, sf_dir).self_find_representative(10, strategy=strategy)
        return found.selected.select(F.col("pick").cast("long").alias("pick"), "vec_id")

    return query


def dedup_ratios(spark, sf_dir):
    result = _documents(spark, sf_dir).self_deduplicate(0.9)
    return spark.createDataFrame([(round(result.duplicate_ratio, 9), round(result.exact_duplicate_ratio, 9))], "duplicate_ratio double, exact_duplicate_ratio double")


def least_similar_embeddings(spark, sf_dir):
    found = _embeddings(spark, sf_dir).self_deduplicate(0.35).least_similar(10)
    return found.select(F.col(POS).alias("vec_id"), F.col("dup_pos").alias("dup_id"), F.round("score", 6).alias("score"))


def rethreshold_embeddings(spark, sf_dir):
    return _decisions(_embeddings(spark, sf_dir).self_deduplicate(0.35).rethreshold(0.4), "vec_id")


def selected_with_duplicates_embeddings(spark, sf_dir):
    found = _embeddings(spark, sf_dir).self_deduplicate(0.35).list_duplicates(["vec_id"])
    return found.select(
        "vec_id",
        F.size("duplicates").cast("long").alias("n"),
        F.array_join(F.array_sort(F.transform("duplicates", lambda d: d["record"]["vec_id"])), ",").alias("duplicates"),
    )


def selected_with_duplicates_documents(spark, sf_dir):
    """Kept documents with the dropped ones that name their text; ids and languages are payload."""
    index = SemanticIndex.fit(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text"], order_by="doc_id")
    found = index.self_deduplicate(0.9).list_duplicates(["doc_id", "lang"])
    ids = F.array_join(F.array_sort(F.transform("duplicates", lambda d: d["record"]["doc_id"])), ",")
    langs = F.array_join(F.array_sort(F.array_distinct(F.transform("duplicates", lambda d: d["record"]["lang"]))), ",")
    return found.select("doc_id", F.size("duplicates").cast("long").alias("n"), ids.alias("duplicates"), langs.alias("langs"))


def type_rules(spark, sf_dir):
    """Which later inputs an index of strings and one of dictionaries refuse."""
    name = _table(spark, sf_dir, "region").orderBy("r_regionkey").first()["r_name"]
    strings = SemanticIndex.fit([name, f"{name} again"], spark=spark)
    records = SemanticIndex.fit([{"name": name}], ["name"], spark=spark)
    cases = {
        "strings of strings": (strings, [name]),
        "dictionaries of strings": (strings, [{"text": name}]),
        "strings of dictionaries": (records, [name]),
        "dictionaries of dictionaries": (records, [{"name": name}]),
        "a mixture": (records, [{"name": name}, name]),
        "nothing": (records, []),
        "numbers": (records, [1]),
        "a frame without the column": (records, spark.range(1)),
    }
    refused = {}
    for case, (index, later) in cases.items():
        try:
            check_like(later, index.was_string, index.columns)
            refused[case] = False
        except ValueError:
            refused[case] = True
    return spark.createDataFrame(list(refused.items()), "case string, refused boolean")


def dict_to_string_conversations(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", dict_to_string(["role", "text"]).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup_documents,
        exact_dedup_multikey,
        exact_groups_documents,
        bigram_vectors,
        threshold_edges_embeddings,
        topk_edges_embeddings,
        threshold_edges_documents,
        self_dedup_embeddings,
        self_dedup_documents,
        self_dedup_pairs_embeddings,
        cross_dedup_documents,
        rank_self_embeddings,
        rank_cross_embeddings,
        outliers_self_embeddings,
        outliers_self_documents,
        dedup_ratios,
        least_similar_embeddings,
        rethreshold_embeddings,
        selected_with_duplicates_embeddings,
        dict_to_string_conversations,
        outliers_cross_embeddings,
        outliers_ratios_embeddings,
        cross_dedup_embeddings,
        representative_cross_mmr_embeddings,
        lsh_edges_embeddings,
        self_dedup_pairs_documents,
        strings_selected,
        strings_filtered,
        prepared_records_nation,
        written_orders,
        selected_with_duplicates_documents,
        type_rules,
    )
}
QUERIES |= {f"representative_{s}_embeddings": _representatives(s) for s in ("mmr", "msd", "dpp", "cover", "ssd")}

_V = "v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
_COS = "list_cosine_similarity(a.e, b.e)"
#: Neighbour lists (src, dst, score) of the embeddings at 0.35, self included, best 100.
_EDGES = f"""{_V}, sim AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst, CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE {_COS} END AS score FROM v a, v b),
edges AS MATERIALIZED (SELECT src, dst, score FROM sim WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 100)"""


def _greedy(edges: str, items: str) -> str:
    """Kept ids by the sequential rule: a recursive walk that carries the list of seen members."""
    return f"""lists AS MATERIALIZED (SELECT src, list(dst) AS l FROM {edges} GROUP BY src),
seq AS MATERIALIZED (SELECT i.id, l.l, row_number() OVER (ORDER BY i.id) AS k FROM {items} i JOIN lists l ON l.src = i.id),
walk AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS id, false AS kept, []::BIGINT[] AS seen
  UNION ALL
  SELECT s.k, s.id, NOT list_has_any(w.seen, s.l), CASE WHEN list_has_any(w.seen, s.l) THEN w.seen ELSE list_concat(w.seen, s.l) END
  FROM walk w JOIN seq s ON s.k = w.k + 1),
lost AS MATERIALIZED (SELECT id FROM walk WHERE k > 0 AND NOT kept)"""


_SELF = f"WITH RECURSIVE {_EDGES}, {_greedy('edges', '(SELECT vec_id AS id FROM v)')}"
_PAIRS = f"{_SELF}, pairs AS MATERIALIZED (SELECT e.src AS vec_id, e.dst AS dup_id, e.score FROM edges e JOIN lost ON lost.id = e.src WHERE e.dst <> e.src)"

_BIGRAMS = """words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\x{2E80}-\\x{9FFF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}]|[\\p{L}\\p{N}]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words),
hashed AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM grams),
vec AS MATERIALIZED (SELECT doc_id, (h >> 1) % 1024 AS bucket, sum(1 - 2 * (h & 1))::BIGINT AS value FROM hashed GROUP BY 1, 2 HAVING sum(1 - 2 * (h & 1)) <> 0)"""


def _document_edges(queries: str, items: str) -> str:
    return f"""norms AS MATERIALIZED (SELECT doc_id, sum(value * value)::DOUBLE AS n FROM vec GROUP BY 1),
dots AS (SELECT a.doc_id AS src, b.doc_id AS dst, sum(a.value * b.value)::DOUBLE AS d FROM vec a JOIN vec b USING (bucket) WHERE a.doc_id IN (SELECT id FROM {queries}) AND b.doc_id IN (SELECT id FROM {items}) GROUP BY 1, 2),
edges AS MATERIALIZED (SELECT src, dst, d / sqrt(x.n * y.n) AS score FROM dots JOIN norms x ON x.doc_id = src JOIN norms y ON y.doc_id = dst WHERE d / sqrt(x.n * y.n) >= 0.9
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY d / sqrt(x.n * y.n) DESC, dst) <= 100)"""


_FIRST = "firsts AS MATERIALIZED (SELECT min(doc_id) AS id FROM documents GROUP BY text)"
_SELF_DOCS = f"WITH RECURSIVE {_BIGRAMS}, {_FIRST}, {_document_edges('firsts', 'firsts')}, {_greedy('edges', 'firsts')}"
_DOC_STATUS = "CASE WHEN f.id IS NULL THEN 'exact' WHEN lost.id IS NOT NULL THEN 'semantic' ELSE 'selected' END"
#: Best means of the 100 nearest others, for all vectors, and for those divisible by 5 against the rest.
_TOP_SELF = f"""{_V}, top AS (SELECT a.vec_id AS src, {_COS} AS score FROM v a, v b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 100),
r AS MATERIALIZED (SELECT src, avg(score) AS score, row_number() OVER (ORDER BY avg(score) DESC, src) AS rank, count(*) OVER () AS n FROM top GROUP BY src)"""
_TOP_CROSS = _TOP_SELF.replace("a.vec_id <> b.vec_id", "a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0")


def _diverse(top: str, strategy: str, k: int = 10) -> str:
    """The strategy's picks among the best ranked, as a walk that carries each candidate's state; diversity 0.5.

    ``near``: cosine with the picked ones so far (largest; sum of 1 - cosine); ``cover``: what
    each candidate has of the picked ones; ``r``, ``res``: rows and what is left of a Cholesky decomposition.
    """
    vector = "[x / sqrt(list_inner_product(v.e, v.e)) for x in v.e]" if strategy == "dpp" else "v.e"
    gain = {
        "mmr": "CASE WHEN step = 0 THEN score ELSE 0.5 * score - 0.5 * near END",
        "msd": "CASE WHEN step = 0 THEN score ELSE 0.5 * score + 0.5 * near END",
        "cover": "0.5 * score + 0.5 * list_sum(list_transform(s, lambda x, i: sqrt(cover[i] + x) - sqrt(cover[i])))",
        "dpp": "(score - max(score) OVER ()) + ln(greatest(res, 1e-12))",
        "ssd": "0.5 * score + 0.5 * sqrt(greatest(res, 0))",
    }[strategy]
    near = "greatest(near, list_cosine_similarity(e, ce))" if strategy == "mmr" else "near + 1 - list_cosine_similarity(e, ce)"
    cover = "list_transform(cover, lambda x, i: x + cs[i])" if strategy == "cover" else "cover"
    row = "(list_inner_product(e, ce) - CASE WHEN step = 0 THEN 0 ELSE list_inner_product(r, cr) END) / sqrt(greatest(cres, 1e-12))"
    rows, left = ("list_append(r, q)", "greatest(res - q * q, 0)") if strategy in ("dpp", "ssd") else ("r", "res")
    s = "(SELECT list(greatest(list_cosine_similarity(v.e, w.e), 0) ORDER BY z.rank) FROM r z JOIN v w ON w.vec_id = z.src WHERE z.rank <= least(greatest(floor(z.n * 0.1), 10, 100), 1000, z.n))" if strategy == "cover" else "[]::DOUBLE[]"
    return f"""WITH RECURSIVE {top},
cand AS MATERIALIZED (SELECT src AS id, rank, score, {vector} AS e, {s} AS s FROM r JOIN v ON v.vec_id = src WHERE rank <= least(greatest(floor(n * 0.1), 10, 100), 1000, n)),
walk AS (
  SELECT 0 AS step, id, rank, score, e, s, {'-1e300::DOUBLE' if strategy == 'mmr' else '0::DOUBLE'} AS near, list_transform(s, lambda x: 0::DOUBLE) AS cover, []::DOUBLE[] AS r, list_inner_product(e, e) AS res, NULL::BIGINT AS pick FROM cand
  UNION ALL
  SELECT step + 1, id, rank, score, e, s, {near}, {cover}, {rows}, {left}, CASE WHEN id = cid THEN step + 1 ELSE pick END
  FROM (SELECT *, {row if strategy in ('dpp', 'ssd') else '0::DOUBLE'} AS q
    FROM (SELECT *, first_value(id) OVER best AS cid, first_value(e) OVER best AS ce, first_value(s) OVER best AS cs, first_value(r) OVER best AS cr, first_value(res) OVER best AS cres
      FROM (SELECT *, {gain} AS gain FROM walk WHERE step < {k})
      WINDOW best AS (ORDER BY pick IS NOT NULL, gain DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))))
SELECT pick, id AS vec_id FROM walk WHERE step = {k} AND pick IS NOT NULL"""


_NAMES = """nations AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name AS t FROM nation), regions AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, r_name AS t FROM region),
sizes AS (SELECT (SELECT count(*) FROM nations) AS a, (SELECT count(*) FROM regions) AS b),
listed AS (SELECT pos, t FROM nations UNION ALL SELECT a + pos, t || ' again' FROM nations, sizes WHERE pos < 5 UNION ALL SELECT a + 5 + pos, t FROM regions, sizes UNION ALL SELECT a + 5 + b + pos, t FROM regions, sizes)"""
_RANK = "row_number() OVER (ORDER BY avg(score) DESC, src)"

ORACLES = {
    "exact_dedup_documents": """SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS kept
  FROM documents""",
    "exact_dedup_multikey": "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS first_key FROM customer",
    "exact_groups_documents": "SELECT min(doc_id) AS first_id, count(*)::BIGINT AS copies FROM documents GROUP BY text HAVING count(*) > 1",
    "bigram_vectors": f"WITH {_BIGRAMS} SELECT doc_id, bucket, value FROM vec",
    "threshold_edges_embeddings": f"WITH {_EDGES} SELECT src, dst, round(score, 6) AS score FROM edges",
    "topk_edges_embeddings": f"""WITH {_V} SELECT a.vec_id AS src, b.vec_id AS dst, round({_COS}, 6) AS score FROM v a, v b WHERE a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 10""",
    "threshold_edges_documents": f"WITH {_BIGRAMS}, {_FIRST}, {_document_edges('firsts', 'firsts')} SELECT src, dst, round(score, 6) AS score FROM edges",
    "self_dedup_embeddings": f"""{_SELF} SELECT v.vec_id, CASE WHEN lost.id IS NULL THEN 'selected' ELSE 'semantic' END AS status FROM v
  LEFT JOIN lost ON lost.id = v.vec_id""",
    "self_dedup_documents": f"""{_SELF_DOCS} SELECT d.doc_id, {_DOC_STATUS} AS status FROM documents d LEFT JOIN firsts f ON f.id = d.doc_id
  LEFT JOIN lost ON lost.id = d.doc_id""",
    "self_dedup_pairs_embeddings": f"{_PAIRS} SELECT vec_id, dup_id, round(score, 6) AS score, false AS exact FROM pairs",
    "cross_dedup_documents": f"""WITH {_BIGRAMS}, q AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 5 = 0),
items AS MATERIALIZED (SELECT min(doc_id) AS id, text FROM documents WHERE doc_id % 5 <> 0 GROUP BY text), {_document_edges('q', 'items')}
SELECT q.id AS doc_id, CASE WHEN q.text IN (SELECT text FROM items) THEN 'exact' WHEN q.id IN (SELECT src FROM edges) THEN 'semantic' ELSE 'selected' END AS status FROM q""",
    "rank_self_embeddings": f"""WITH {_V}, top AS (SELECT a.vec_id AS src, {_COS} AS score FROM v a, v b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 100)
SELECT src AS vec_id, round(avg(score), 6) AS score, {_RANK} AS rank FROM top GROUP BY src""",
    "rank_cross_embeddings": f"""WITH {_V}, top AS (SELECT a.vec_id AS src, {_COS} AS score FROM v a, v b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 100)
SELECT src AS vec_id, round(avg(score), 6) AS score, {_RANK} AS rank FROM top GROUP BY src""",
    "outliers_self_embeddings": f"""WITH {_V}, top AS (SELECT a.vec_id AS src, {_COS} AS score FROM v a, v b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 100),
r AS (SELECT src, {_RANK} AS rank, count(*) OVER () AS n FROM top GROUP BY src) SELECT src AS vec_id FROM r WHERE rank > n - ceil(n * 0.1::DOUBLE)""",
    "outliers_self_documents": """WITH n AS (SELECT count(DISTINCT text) AS n FROM documents) SELECT 'selected' AS status, (n - ceil(n * 0.1::DOUBLE))::BIGINT AS n
  FROM n UNION ALL SELECT 'filtered', ceil(n * 0.1::DOUBLE)::BIGINT FROM n""",
    "dedup_ratios": f"""{_SELF_DOCS}
  SELECT round(1.0::DOUBLE - count(*) FILTER ({_DOC_STATUS} = 'selected')::DOUBLE / count(*), 9) AS duplicate_ratio, round(count(*) FILTER ({_DOC_STATUS} = 'exact')::DOUBLE / count(*), 9) AS exact_duplicate_ratio
  FROM documents d LEFT JOIN firsts f ON f.id = d.doc_id LEFT JOIN lost ON lost.id = d.doc_id""",
    "least_similar_embeddings": f"{_PAIRS} SELECT vec_id, dup_id, round(score, 6) AS score FROM pairs ORDER BY pairs.score, vec_id, dup_id LIMIT 10",
    "rethreshold_embeddings": f"""{_PAIRS} SELECT v.vec_id, CASE WHEN v.vec_id IN (SELECT vec_id FROM pairs
  WHERE score >= 0.4) THEN 'semantic' ELSE 'selected' END AS status FROM v""",
    "selected_with_duplicates_embeddings": f"""{_PAIRS}, named AS (SELECT dup_id, count(*)::BIGINT AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS l FROM pairs
  GROUP BY dup_id) SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n, coalesce(l, '') AS duplicates FROM v
  LEFT JOIN named ON named.dup_id = v.vec_id WHERE v.vec_id NOT IN (SELECT id FROM lost)""",
    "dict_to_string_conversations": """SELECT conv_id, turn, replace(coalesce(role, ''), chr(9), ' ') || chr(9) || replace(coalesce(text, ''), chr(9), ' ') AS line
  FROM conversations""",
    "outliers_cross_embeddings": f"WITH {_TOP_CROSS} SELECT src AS vec_id FROM r WHERE rank > n - ceil(n * 0.1::DOUBLE)",
    "outliers_ratios_embeddings": """WITH n AS (SELECT count(*) AS n FROM embeddings)
  SELECT round(ceil(n * 0.1::DOUBLE) / n, 9) AS filter_ratio, round(1 - ceil(n * 0.1::DOUBLE) / n, 9) AS selected_ratio FROM n""",
    "cross_dedup_embeddings": f"""WITH {_V} SELECT a.vec_id, CASE WHEN max({_COS}) >= 0.35 THEN 'semantic' ELSE 'selected' END AS status FROM v a, v b
  WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY a.vec_id""",
    "representative_cross_mmr_embeddings": _diverse(_TOP_CROSS, "mmr"),
    "lsh_edges_embeddings": f"WITH {_EDGES} SELECT src, dst, round(score, 6) AS score FROM edges WHERE src <> dst",
    "self_dedup_pairs_documents": f"""{_SELF_DOCS}, named AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, text FROM documents)
SELECT a.doc_id, b.doc_id AS dup_id, 1.0::DOUBLE AS score, true AS exact FROM named a JOIN named b ON a.text = b.text AND a.doc_id <> b.doc_id WHERE a.doc_id <> a.first
UNION ALL SELECT e.src, b.doc_id, round(e.score, 6), false FROM edges e JOIN lost ON lost.id = e.src JOIN named b ON b.first = e.dst WHERE b.doc_id <> e.src""",
    "selected_with_duplicates_documents": f"""{_SELF_DOCS}, named AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, text, lang FROM documents),
pairs AS (SELECT a.doc_id, b.first FROM named a JOIN named b ON a.text = b.text AND a.doc_id <> b.doc_id WHERE a.doc_id <> a.first
  UNION SELECT e.src, e.dst FROM edges e JOIN lost ON lost.id = e.src JOIN named b ON b.first = e.dst WHERE b.doc_id <> e.src),
listed AS (SELECT p.first, p.doc_id, d.lang FROM (SELECT DISTINCT * FROM pairs) p JOIN documents d USING (doc_id)),
found AS (SELECT first, count(*)::BIGINT AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM listed GROUP BY first)
SELECT k.doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(ids, '') AS duplicates, coalesce(langs, '') AS langs
FROM named k LEFT JOIN found f ON f.first = k.doc_id WHERE k.doc_id = k.first AND k.doc_id NOT IN (SELECT id FROM lost)""",
    "type_rules": """SELECT * FROM (VALUES ('strings of strings', false), ('dictionaries of strings', false), ('strings of dictionaries', true), ('dictionaries of dictionaries', false),
  ('a mixture', true), ('nothing', true), ('numbers', true), ('a frame without the column', true)) t("case", refused)""",
    "strings_selected": f"WITH {_NAMES} SELECT min(pos)::BIGINT AS pos, t AS text FROM listed GROUP BY t",
    "strings_filtered": f"""WITH {_NAMES} SELECT pos::BIGINT AS pos, t AS text, true AS exact, 1::BIGINT AS n, t AS duplicate, 1.0::DOUBLE AS score
  FROM listed QUALIFY row_number() OVER (PARTITION BY t ORDER BY pos) > 1""",
    "prepared_records_nation": """SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS pos, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_regionkey::VARCHAR END AS region
  FROM nation""",
    "written_orders": "SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_custkey::BIGINT AS again FROM orders",
}
ORACLES |= {f"representative_{s}_embeddings": _diverse(_TOP_SELF, s) for s in ("mmr", "msd", "dpp", "cover", "ssd")}
