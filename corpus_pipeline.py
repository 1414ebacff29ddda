"""A training-data pipeline over ``documents``: quality rules, language ID, near-duplicates, mixing, encoding.

Each stage works on all rows that the one before kept. The first four return the columns of documents;
the last returns, for every row of the mixture, its token ids and digests. ORACLE_SQL is None: the
fitted models and the encoder cannot be stated in SQL, so tests hold the stages against brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scorelake.llm import langid, minhash, mixing, pieces, quality
from scorelake.session import materialise, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the base test and is good by its rules' votes."""
    prepare(spark)
    return quality.good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is in a known language; the model learns from the stage's own rows."""
    prepare(spark)
    return langid.confident(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group."""
    prepare(spark)
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture to smoothed weights in slot order: every document, those of small sources repeated."""
    prepare(spark)
    return mixing.in_order(docs, mixing.mixed(docs, 0.7, name="__mix"), "__mix")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, and whether its pieces are those of their spans in the text."""
    prepare(spark)
    done = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), spans=False)
    return done.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "aligned")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
