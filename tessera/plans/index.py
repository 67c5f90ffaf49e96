"""The fitted dataset and its six operations.

Differences from an in-memory library of the same purpose, by design: order is
explicit (``order_by``), search is exact by default, thresholds are inclusive,
an item's own entry is recognised by its id, results are never changed in
place, diversification uses the stored vectors (``reencode=True`` encodes the
candidates again), and nulls must be filled before encoding.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.encoders import Encoder, HashedBigramEncoder, featurize
from tessera.functions.records import full_record
from tessera.operators import diversify as div
from tessera.operators import exact, greedy, ranking, similarity
from tessera.plans.results import DeduplicationResult, FilterResult
from tessera.sources.tables import POS, check_like, few, materialize, prepare

CAP = 100
TOP = 100


class SemanticIndex:
    """Records (``_pos``, fields, ``group_pos``) and the vectors of one record per key."""

    def __init__(self, records: DataFrame, vectors: DataFrame, columns: Sequence[str], encoder: Encoder | None, was_string: bool = False, search: str = "exact", **search_options):
        self.records, self.vectors, self.columns, self.encoder = records, vectors, list(columns), encoder
        self.was_string, self.method, self.options = was_string, search, search_options

    @classmethod
    def fit(
        cls,
        records: DataFrame | Sequence,
        columns: Sequence[str] | None = None,
        encoder: Encoder | None = None,
        order_by: str | Sequence[str] | None = None,
        spark: SparkSession | None = None,
        search: str = "exact",
        **options,
    ) -> SemanticIndex:
        """Group exact copies, encode one record of each key, keep the vectors."""
        spark = records.sparkSession if isinstance(records, DataFrame) else spark or SparkSession.getActiveSession()
        rows, columns, was_string = prepare(spark, records, columns, order_by)
        encoder = encoder or HashedBigramEncoder()
        grouped = materialize(exact.with_groups(rows, columns), "records")
        if grouped.isEmpty():
            raise ValueError("there are no records")
        items = grouped.where(F.col(POS) == F.col("group_pos"))
        vectors = materialize(featurize(items, "group_pos", columns, encoder).withColumnRenamed("group_pos", "item"), "vectors")
        return cls(grouped, vectors, columns, encoder, was_string, search, **options)

    @classmethod
    def fit_embeddings(
        cls,
        records: DataFrame | Sequence,
        embeddings: str | np.ndarray,
        columns: Sequence[str] | None = None,
        encoder: Encoder | None = None,
        order_by: str | Sequence[str] | None = None,
        spark: SparkSession | None = None,
        search: str = "exact",
        **options,
    ) -> SemanticIndex:
        """Like ``fit`` with given vectors: a column of the DataFrame, or an array with a row per record.

        The first vector of each key counts.
        """
        if isinstance(records, DataFrame):
            if not isinstance(embeddings, str):
                raise ValueError("name the column that holds the embeddings")
            spark = records.sparkSession
            rows, columns, was_string = prepare(spark, records, columns, order_by)
            vector = F.col(embeddings).cast("array<double>")
            sizes = rows.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b"), F.count("*").alias("n")).first()
            if not sizes["n"]:
                raise ValueError("there are no records")
            if sizes["a"] != sizes["b"] or sizes["a"] < 1:
                raise ValueError("embeddings must all have one length")
        else:
            if len(records) == 0:
                raise ValueError("there are no records")
            data = np.asarray(embeddings, dtype=np.float64)
            if data.ndim != 2:
                raise ValueError(f"expected one vector a record (2D), got an array of shape {data.shape}")
            if len(data) != len(records):
                raise ValueError(f"Number of embeddings ({len(data)}) and of records ({len(records)}) differ")
            spark = spark or SparkSession.getActiveSession()
            rows, columns, was_string = prepare(spark, records, columns)
            vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], f"{POS} long, _vector array<double>")
            rows, vector = rows.join(vectors, POS), F.col("_vector")
        grouped = materialize(exact.with_groups(rows, columns), "records")
        vectors = grouped.where(F.col(POS) == F.col("group_pos")).select(F.col("group_pos").alias("item"), vector.alias("vector"))  # read from the records
        return cls(grouped.drop("_vector"), vectors, columns, encoder, was_string, search, **options)

    @property
    def fields(self) -> list[str]:
        return [c for c in self.records.columns if c not in (POS, "group_pos")]

    def _search(self, queries: DataFrame, k: int | None, threshold: float | None, skip_self: bool, means: bool = False) -> DataFrame:
        return similarity.search(queries, self.vectors, k, threshold, skip_self, self.method, means=means, **self.options)

    def _incoming(self, records: DataFrame | Sequence, order_by) -> DataFrame:
        check_like(records, self.was_string, self.columns)
        rows, _, strings = prepare(self.records.sparkSession, records, self.columns, order_by)
        return materialize(rows, "queries")

    def _encoded(self, rows: DataFrame, embeddings: str | None) -> DataFrame:
        """(_pos, vector): of the named column, else encoded."""
        if embeddings is not None:
            return rows.select(POS, F.col(embeddings).cast("array<double>").alias("vector"))
        return featurize(rows, POS, self.columns, self.encoder)

    # -- deduplication -------------------------------------------------------------

    def self_deduplicate(self, threshold: float = 0.9, cap: int | None = CAP) -> DeduplicationResult:
        """Greedy two-hop rule over lists of at most ``cap`` neighbours (``None``: all of them); exact copies of a key's first record are always dropped."""
        edges = self._search(self.vectors, cap, threshold, False)
        lost = greedy.dropped_items(edges)
        dropped = few(lost)
        status = F.when(F.col(POS) != F.col("group_pos"), "exact").when(F.col("_drop"), "semantic").otherwise("selected")
        decisions = self.records.join(dropped.select(F.col("src").alias(POS), F.lit(True).alias("_drop")), POS, "left").withColumn("status", status).drop("_drop")
        if dropped is lost:  # a join that shuffles the records is done once; one with a broadcast is no more than reading them
            decisions = materialize(decisions, "decisions")
        found = edges.join(dropped, "src", "left_semi")
        exact_links = decisions.where("status = 'exact'").select(POS, F.col("group_pos").alias("group"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
        near_links = found.where("src <> dst").select(F.col("src").alias(POS), F.col("dst").alias("group"), "score", F.lit(False).alias("exact"))
        links = exact_links.unionByName(near_links)
        # Records are equal in all fields only within a group: only a lost record's own copies are compared with it.
        copies = self.records.where(F.col(POS) != F.col("group_pos"))
        places = few(copies.select(F.col("group_pos").alias("group"), F.col(POS).alias("dup_pos")))
        copied = few(copies.select(F.col("group_pos").alias("src")).distinct())
        own = found.where("src = dst").join(copied, "src", "left_semi").join(copies.select(F.col("group_pos").alias("dst"), F.col(POS).alias("dup_pos"), full_record(self.fields).alias("theirs")), "dst")
        mine = self.records.select(F.col(POS).alias("src"), *self.fields).join(copied, "src", "left_semi")
        own = own.join(mine.select("src", full_record(self.fields).alias("mine")), "src").where("mine <> theirs")
        own = own.select(F.col("src").alias(POS), "dup_pos", "score", F.lit(False).alias("exact"))
        firsts = links.select(POS, F.col("group").alias("dup_pos"), "score", "exact")
        others = links.join(places, "group").where(F.col(POS) != F.col("dup_pos")).select(POS, "dup_pos", "score", "exact")
        pairs = firsts.unionByName(others).unionByName(own)
        return DeduplicationResult(decisions, pairs, self.records, self.columns, threshold, self.was_string, links)

    def deduplicate(
        self,
        records: DataFrame | Sequence,
        threshold: float = 0.9,
        order_by: str | Sequence[str] | None = None,
        cap: int | None = CAP,
        embeddings: str | None = None,
    ) -> DeduplicationResult:
        """Drop records that equal or resemble a fitted one (at most ``cap`` pairs each, ``None``: all); they are never compared with each other.  ``embeddings`` names a column of given vectors."""
        queries = exact.match_exact(self._incoming(records, order_by), self.records, self.columns)
        queries = materialize(queries, "matched")
        rest = queries.where("group_pos IS NULL")
        edges = self._search(self._encoded(rest, embeddings), cap, threshold, False)
        near = edges.select(F.col("src").alias(POS)).distinct().withColumn("_near", F.lit(True))
        status = F.when(F.col("group_pos").isNotNull(), "exact").when(F.col("_near"), "semantic").otherwise("selected")
        decisions = materialize(queries.join(near, POS, "left").withColumn("status", status).drop("_near"), "decisions")
        members = self.records.select("group_pos", F.col(POS).alias("dup_pos"))
        copies = decisions.where("status = 'exact'").select(POS, "group_pos").join(members, "group_pos").select(
            POS,
            "dup_pos",
            F.lit(1.0).alias("score"),
            F.lit(True).alias("exact"),
        )
        alike = edges.join(members, edges["dst"] == members["group_pos"]).select(F.col("src").alias(POS), "dup_pos", "score", F.lit(False).alias("exact"))
        links = decisions.where("status = 'exact'").select(POS, F.col("group_pos").alias("group"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
        links = links.unionByName(edges.select(F.col("src").alias(POS), F.col("dst").alias("group"), "score", F.lit(False).alias("exact")))
        return DeduplicationResult(decisions, copies.unionByName(alike), self.records, self.columns, threshold, self.was_string, links)

    # -- ranking ---------------------------------------------------------------------

    @cached_property
    def _self_ranking(self) -> DataFrame:
        means = self._search(self.vectors, TOP, None, True, means=True)
        return materialize(ranking.rank_by_mean(means, self.vectors, "item").withColumnRenamed("item", POS), "ranking")

    def _ranking(self, records: DataFrame | Sequence, order_by, embeddings: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        queries = self._incoming(records, order_by)
        vectors = materialize(self._encoded(queries, embeddings), "vectors")
        ranks = materialize(ranking.rank_by_mean(self._search(vectors, TOP, None, False, means=True), vectors, POS), "ranking")
        return ranks, queries, vectors

    @staticmethod
    def _outliers(ranks: DataFrame, rows: DataFrame, share: float) -> FilterResult:
        n = ranks.count()
        kept = n - ceil(n * share)  # in IEEE doubles, on the driver
        status = F.when(F.col("rank") <= kept, "selected").otherwise("filtered")
        return FilterResult(ranks.withColumn("status", status).join(rows, POS))

    def self_filter_outliers(self, outlier_percentage: float = 0.1) -> FilterResult:
        """The lowest share of the fitted items by mean similarity to their nearest neighbours."""
        _check_share(outlier_percentage)
        return self._outliers(self._self_ranking, self.records.drop("group_pos"), outlier_percentage)

    def filter_outliers(self, records: DataFrame | Sequence, outlier_percentage: float = 0.1, order_by=None, embeddings: str | None = None) -> FilterResult:
        _check_share(outlier_percentage)
        ranks, queries, _ = self._ranking(records, order_by, embeddings)
        return self._outliers(ranks, queries, outlier_percentage)

    # -- representatives ---------------------------------------------------------------

    def _diversify(self, ranks: DataFrame, rows: DataFrame, vectors: DataFrame, size: int, limit: int | str, diversity: float, strategy, reencode: bool) -> FilterResult:
        if limit == "auto":
            limit = div.candidate_limit(ranks.count(), size)
        chosen = ranks.where(F.col("rank") <= limit)
        if reencode:
            vectors = featurize(rows.join(chosen.select(POS), POS, "left_semi"), POS, self.columns, self.encoder)
        found = F.broadcast(chosen).join(vectors, POS).select(POS, "score", "rank", "vector").orderBy("rank").collect()  # at most ``limit`` rows
        picks, gains = div.diversify(np.array([r["vector"] for r in found]), np.array([r["score"] or 0.0 for r in found]), size, strategy, diversity) if found else ([], [])
        made = [(found[j][POS], i + 1, gains[i]) for i, j in enumerate(picks)]
        picked = rows.sparkSession.createDataFrame(made, f"{POS} long, pick int, selection_score double")
        out = F.broadcast(chosen.withColumnRenamed("score", "relevance").join(F.broadcast(picked), POS, "left")).join(rows, POS)
        out = out.withColumn("score", F.coalesce("selection_score", "relevance"))
        return FilterResult(out.withColumn("status", F.when(F.col("pick").isNotNull(), "selected").otherwise("filtered")))

    def self_find_representative(
        self,
        selection_size: int = 10,
        candidate_limit: int | str = "auto",
        diversity: float = 0.5,
        strategy: div.Strategy | str = div.Strategy.MMR,
        reencode: bool = False,
    ) -> FilterResult:
        vectors = self.vectors.withColumnRenamed("item", POS)
        return self._diversify(self._self_ranking, self.records.drop("group_pos"), vectors, selection_size, candidate_limit, diversity, strategy, reencode)

    def find_representative(
        self,
        records: DataFrame | Sequence,
        selection_size: int = 10,
        candidate_limit: int | str = "auto",
        diversity: float = 0.5,
        strategy: div.Strategy | str = div.Strategy.MMR,
        order_by=None,
        embeddings: str | None = None,
    ) -> FilterResult:
        ranks, queries, vectors = self._ranking(records, order_by, embeddings)
        return self._diversify(ranks, queries, vectors, selection_size, candidate_limit, diversity, strategy, False)


def _check_share(share: float) -> None:
    if not 0.0 <= share <= 1.0:
        raise ValueError("outlier_percentage must be between 0 and 1")
