"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from prefixlake.llm import chat_format, fingerprints, jaccard_join, lang_id, license_scan, line_dedup, mixing, quality_rules, sentencepiece_codec, toxicity
from prefixlake.llm.common import documents
from prefixlake.llm.sql import SQL

def op1_line_dedup(spark, sf_dir):
    return line_dedup.dedup_report(documents(spark, sf_dir))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.codec_report(documents(spark, sf_dir))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(documents(spark, sf_dir))


def op5_license_scan(spark, sf_dir):
    return license_scan.scan(documents(spark, sf_dir))


def op6_language_id(spark, sf_dir):
    return lang_id.identify(documents(spark, sf_dir))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.grouped(documents(spark, sf_dir))


def op8_fingerprints(spark, sf_dir):
    return fingerprints.edit_report(documents(spark, sf_dir))


def op9_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat_format.read_report(chat_format.with_mask(chat_format.examples(rows.unionByName(added))))


def op10_mix_sources(spark, sf_dir):
    return mixing.mixed_report(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_sentencepiece, op4_quality_rules, op5_license_scan, op6_language_id, op7_jaccard_join, op8_fingerprints, op9_chat_format, op10_mix_sources)}

__all__ = ["QUERIES", "SQL"]
