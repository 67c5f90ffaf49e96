"""Registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, htmltext, lm, neardup, orderminhash, packing, perspectives, quality, simple8b, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark, sf_dir):
    return orderminhash.order_minhash(table(spark, sf_dir, "documents"))


def op2_simple8b(spark, sf_dir):
    return simple8b.simple8b_corpus(table(spark, sf_dir, "documents"))


def op3_circulant_minhash(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark))


def op6_line_blocks(spark, sf_dir):
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op7_attention_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_perspectives(spark, sf_dir):
    rows = perspectives.rotate(table(spark, sf_dir, "conversations"))
    masked = F.expr("transform(spans, s -> concat_ws(':', s.start, s.end, s.mask))")
    return rows.withColumn("spans", F.array_join(masked, ","))


def op9_positional_index(spark, sf_dir):
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op10_attention_lm(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_simple8b, op3_circulant_minhash, op4_packing, op5_url_filter, op6_line_blocks, op7_attention_quality, op8_perspectives, op9_positional_index, op10_attention_lm)}
