"""A training-data pipeline over ``documents``: five stages, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and decides over all rows that the one before it
kept. All but the last return the columns of ``documents``. No stage but mixing is
expressible in SQL, so there is no oracle; tests compare the stages with plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.llm import bpe, jaccard, mixing, pii, toxicity
from agentlake.llm.common import free_name, table, written
from agentlake.llm.queries import REPETITION

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the network learns from labels of ``docs``."""
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.score(docs, network, column=score).where(F.col(score) < 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts; every text of an id is judged by itself."""
    return jaccard.keep_one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    clean = pii.masked(docs, pii.fit_field(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reading of a document in a mix of the sources, as many words as there are."""
    return mixing.mix(docs, repetition=REPETITION).select(docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every reading, and the digest of the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded_sha256="decoded_sha256")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
