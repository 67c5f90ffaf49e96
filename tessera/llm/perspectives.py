"""Operator 8: chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as ``assistant`` and the others as users named after themselves:

    <|assistant|>\\n{text}\\n<|end|>\\n        (its text and end mark are trained on: mask 1)
    <|user name={role}|>\\n{text}\\n<|end|>\\n  (mask 0)

Markers inside a text or a role are escaped (``<|`` becomes ``<\\|`` and ``|>`` becomes
``|\\>``), so no text can forge a turn.  ``spans`` holds start, end and mask of each
message's text with its end mark in ``rendered`` (code points).

A row renders up to ``segment`` consecutive messages, so a conversation of any
length is a run of bounded rows.  Messages are numbered over range partitions of
the whole table, so no conversation has to fit in one task.

Defined cases: a null role speaks as ``unknown``, a null text is empty; messages are
ordered by turn (null first), then role, then text; a null ``conv_id`` is a
conversation of its own; repeated rows all stay; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.util import columns, materialize
from tessera.operators.components import HOT, join_hot
from tessera.operators.ranking import numbered

END = "\n<|end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate(conversations: DataFrame, segment: int = 64) -> DataFrame:
    """(conv_id, participant, segment, rendered, spans, n_messages, n_trained)."""
    rows = columns(conversations, conv_id="long", turn="long", role="string", text="string")
    rows = rows.select(
        "conv_id",
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = materialize(numbered(rows, [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], "at", 0), "messages")
    begins = materialize(rows.groupBy("conv").agg(F.min("at").alias("begin"), F.count("*").alias("n"), F.collect_set("role").alias("people")), "begins")
    hot = begins.where(F.col("n") > max(1.0, rows.count() * HOT))
    placed = join_hot(rows, begins.select("conv", "begin"), "conv", hot)
    placed = placed.withColumn("segment", F.floor((F.col("at") - F.col("begin")) / segment))
    parts = placed.groupBy("conv", "conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("messages"))
    whole = join_hot(parts, begins.select("conv", "people"), "conv", hot).withColumn("participant", F.explode("people"))

    def head(m):
        return F.when(m["role"] == F.col("participant"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), escaped(m["role"]), F.lit("|>\n")))

    def piece(m):
        body = F.concat(escaped(m["text"]), F.lit(END))
        return F.struct(
            F.concat(head(m), body, F.lit("\n")).alias("piece"),
            F.length(head(m)).alias("head"),
            F.length(body).alias("body"),
            (m["role"] == F.col("participant")).cast("int").alias("mask"),
        )

    whole = whole.withColumn("pieces", F.transform("messages", piece))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,mask:int>>").alias("spans"))
    spans = F.aggregate(  # over ``segment`` messages at most
        "pieces", start,
        lambda s, p: F.struct(
            (s["at"] + p["head"] + p["body"] + 1).alias("at"),
            F.concat(s["spans"], F.array(F.struct((s["at"] + p["head"]).alias("start"), (s["at"] + p["head"] + p["body"]).alias("end"), p["mask"].alias("mask")))).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    trained = F.aggregate("pieces", F.lit(0), lambda n, p: n + p["mask"])
    return whole.select(
        "conv_id",
        "participant",
        "segment",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered"),
        spans.alias("spans"),
        F.size("pieces").cast("long").alias("n_messages"),
        trained.cast("long").alias("n_trained"),
    )
