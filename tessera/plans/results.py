"""Result objects: thin wrappers over DataFrames.

``decisions`` (every record with ``_pos``, ``group_pos`` and ``status``: selected,
exact or semantic) and ``pairs`` (dropped record, duplicate, score, exact) are
the source of truth; everything else is derived from them, and nothing is
changed in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.records import dict_to_string, full_record
from tessera.sources.tables import POS, few


@dataclass(frozen=True)
class DeduplicationResult:
    """decisions, pairs (_pos, dup_pos, score, exact), targets, the records that dup_pos points to, and links: pairs of a dropped record and another key's or its own first record (_pos, group, score, exact)."""

    decisions: DataFrame
    pairs: DataFrame
    targets: DataFrame
    columns: Sequence[str]
    threshold: float
    was_string: bool
    links: DataFrame

    @property
    def fields(self) -> list[str]:
        return [c for c in self.decisions.columns if c not in (POS, "group_pos", "status", "order")]

    def _shown(self, df: DataFrame) -> DataFrame:
        """String records come back as strings, their tabs as spaces."""
        return df.withColumn("text", dict_to_string(self.columns)) if self.was_string else df

    @property
    def selected(self) -> DataFrame:
        return self._shown(self.decisions.where("status = 'selected'")).select(POS, *self.fields)

    @property
    def filtered(self) -> DataFrame:
        """Dropped records with ``exact`` and ``duplicates``: array of (record, score), best first."""
        dropped = self._shown(self.decisions.where("status <> 'selected'"))
        names = [c for c in self.targets.columns if c not in (POS, "group_pos", "status", "order")]
        shown = self._shown(self.targets).select(F.col(POS).alias("dup_pos"), F.struct(*names).alias("record"))
        entry = F.struct((-F.col("score")).alias("_by"), F.col("dup_pos").alias("_then"), F.col("record"), F.col("score"))
        lists = self.pairs.join(shown, "dup_pos").groupBy(POS).agg(F.sort_array(F.collect_list(entry)).alias("d"))
        lists = lists.select(POS, F.transform("d", lambda x: F.struct(x["record"].alias("record"), x["score"].alias("score"))).alias("duplicates"))
        out = dropped.join(lists, POS, "left")
        empty = F.array().cast(dict(lists.dtypes)["duplicates"])
        return out.select(POS, *self.fields, (F.col("status") == "exact").alias("exact"), F.coalesce("duplicates", empty).alias("duplicates"))

    @cached_property
    def _counts(self) -> dict[str, int]:
        return {r["status"]: r["n"] for r in self.decisions.groupBy("status").agg(F.count("*").alias("n")).collect()}

    @property
    def duplicate_ratio(self) -> float:
        total = sum(self._counts.values())
        return 1.0 - self._counts.get("selected", 0) / total if total else 0.0

    @property
    def exact_duplicate_ratio(self) -> float:
        total = sum(self._counts.values())
        return self._counts.get("exact", 0) / total if total else 0.0

    def least_similar(self, n: int = 1) -> DataFrame:
        """The n least similar pairs (_pos, dup_pos, score), ties by position."""
        return self.pairs.select(POS, "dup_pos", "score").orderBy("score", POS, "dup_pos").limit(n)

    def rethreshold(self, threshold: float) -> DeduplicationResult:
        """Pairs of at least ``threshold``; dropped records left without a pair follow the selected ones.

        The greedy rule is not run again: a record whose neighbours were all
        dropped stays dropped.
        """
        if self.threshold > threshold:
            raise ValueError("the threshold can only be raised")
        pairs = self.pairs.where(F.col("score") >= threshold)
        backed = pairs.select(POS).distinct().withColumn("_backed", F.lit(True))
        back = (F.col("status") != "selected") & F.col("_backed").isNull()
        decisions = self.decisions.join(backed, POS, "left")
        decisions = decisions.withColumn("status", F.when(back, F.lit("selected")).otherwise(F.col("status"))).drop("_backed")
        return replace(self, decisions=decisions, pairs=pairs, links=self.links.where(F.col("score") >= threshold), threshold=threshold)

    @cached_property
    def selected_with_duplicates(self) -> DataFrame:
        """Kept records with the dropped records that name a record of the same key, whole."""
        return self.list_duplicates()

    def list_duplicates(self, fields: Sequence[str] | None = None) -> DataFrame:
        """``selected_with_duplicates`` whose records hold only the named fields.

        Equal dropped records (in all fields) are listed once: the last score, the first place.
        Pairs are of positions until the end, so that no record is carried once a pair.
        """
        names = self.fields if fields is None else list(fields)
        kept = self.decisions.where("status = 'selected'")
        dropped = self.decisions.where("status <> 'selected'").select(POS, F.col("group_pos").alias("drop_group"), (F.col("status") == "semantic").alias("late"))
        # Of the many links few name a kept record, so those are sought first.
        found = self.links.select(POS, "group", "score").join(few(kept.select(F.col("group_pos").alias("group"), F.col(POS).alias("kept"))), "group")
        found = found.join(dropped, POS)
        # Equal records have one key, so only those of a key that lost several are compared.
        several = few(dropped.groupBy("drop_group").agg(F.count("*").alias("n")).where("n > 1").select(F.col("drop_group").alias("group_pos")))
        alike = self.decisions.where("status <> 'selected'").join(several, "group_pos").select(POS, "group_pos", full_record(self.fields).alias("json"))
        first = alike.groupBy("group_pos", "json").agg(F.min(POS).alias("same"))
        same = alike.join(first, ["group_pos", "json"]).select(POS, "same")
        found = found.join(same, POS, "left").withColumn("same", F.coalesce("same", POS))
        place = F.struct("drop_group", "late", F.col(POS).alias("drop_pos"))
        once = found.groupBy("kept", "same").agg(F.min(place).alias("first"), F.max(F.struct(place.alias("place"), "score"))["score"].alias("score"))
        shown = self._shown(self.decisions.where("status <> 'selected'")).select(F.col(POS).alias("drop_pos"), F.struct(*names).alias("record"))
        once = once.withColumn("drop_pos", F.col("first.drop_pos")).join(shown, "drop_pos")
        # Two entries of a list differ in their place, so it alone orders them and no map is compared.
        entry = F.struct("first", "record", "score")
        order = lambda a, b: F.when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0)
        lists = once.groupBy(F.col("kept").alias(POS)).agg(F.array_sort(F.collect_list(entry), order).alias("d"))
        lists = lists.select(POS, F.transform("d", lambda x: F.struct(x["record"].alias("record"), x["score"].alias("score"))).alias("duplicates"))
        empty = F.array().cast(dict(lists.dtypes)["duplicates"])
        return self._shown(kept).select(POS, *names).join(lists, POS, "left").withColumn("duplicates", F.coalesce("duplicates", empty))


@dataclass(frozen=True)
class FilterResult:
    """rows: records with ``score``, ``rank`` and ``status`` (selected or filtered)."""

    rows: DataFrame

    @property
    def selected(self) -> DataFrame:
        return self.rows.where("status = 'selected'")

    @property
    def filtered(self) -> DataFrame:
        return self.rows.where("status = 'filtered'")

    @cached_property
    def filter_ratio(self) -> float:
        row = self.rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "filtered").alias("f")).first()
        return row["f"] / row["n"] if row["n"] else 0.0

    @property
    def selected_ratio(self) -> float:
        return 1 - self.filter_ratio
