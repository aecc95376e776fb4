"""A training-data pipeline over `documents`: each stage works on all that its predecessor kept.

Stages: toxic documents go; of near-duplicate documents (five-word runs, Jaccard similarity of 0.8 or more, also
by way of others) the one with the smallest doc_id stays; personal data is replaced; documents are drawn to target
weights of source, language and topic; what is left is encoded to token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import bpe, mixing, ngram_join, pii, toxicity
from tradewind.llm.common import read, written

#: Share of the tokens that mixing keeps.
BUDGET = 0.8


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The classifier learns from the labelled rows of the learning folds."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays; rows that repeat it are one. Rows without doc_id stay."""
    return ngram_join.survivors(docs, k=5, num=4, den=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts; n_chars follows."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else redacted


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the raked weights of source, language and topic."""
    return mixing.sampled(docs, budget=BUDGET)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids: byte-level BPE ids that decode to the text."""
    rank_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs, rank_file, pattern, kept=("source", "lang")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("token_ids", token_ids)]

#: The classifier and the raking by rounds are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
