"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from prefixlake.llm import jaccard_join, line_dedup, mixing, quality_rules, sentencepiece_codec
from prefixlake.llm.common import documents, shared_dir


def quality(spark, docs, sf_dir):
    return quality_rules.quality_filter(docs)


def lines(spark, docs, sf_dir):
    return line_dedup.dedup(docs).select(*docs.columns)


def distinct(spark, docs, sf_dir):
    return jaccard_join.deduplicated(docs)


def mixed(spark, docs, sf_dir):
    return mixing.mix(docs)


def tokens(spark, docs, sf_dir):
    return sentencepiece_codec.encoded(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", distinct), ("mixing sources to target weights", mixed), ("SentencePiece encoding and decoding", tokens)]

#: SentencePiece codes can't be made in SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage."""
    docs, top = documents(spark, sf_dir), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
