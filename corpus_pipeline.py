"""A corpus, from raw documents to token ids: five stages, each over all that the one
before it kept.

toxicity      documents that the classifier rejects go
near_join     of each group of near duplicates, the document of the least id stays
secrets       live credentials are cut out of the texts
mixing        documents are taken, or repeated, by their source's share of the mix
byte_bpe      texts become token ids, which are decoded again for the check digest

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents.

Null or empty texts are scored, kept by toxicity, near_join and secrets, and left out by the
mix, which takes nothing of them. Null ids and sources are kept like any others; repeated
rows are near duplicates, of which one stays. Texts are handled whole, however long. Columns
besides doc_id, text and source pass through all but the last stage, whatever their names
(n_chars follows a text that is cut). An empty table passes every stage without rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from termforge.llm import bpe, classify, mixing, near_join, secrets
from termforge.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classify.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenised(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_join", near_duplicates), ("secrets", secret_scan), ("mixing", mix_sources), ("byte_bpe", byte_bpe)]

#: Trained trees and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
