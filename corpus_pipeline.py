"""A training corpus from the documents table, stage by stage: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import dedup, language, mixing, near_dups
from corvane.llm.common import cut
from corvane.llm.queries import bpe_digests
from corvane.sources import table

#: The language stage keeps a document if its language is known to be one of those learned, with at least this score.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or whose language stays unclear, go; rows are judged one by one, repeats alike."""
    found = language.predict(docs, language.train(docs))
    pred, score = found.columns[-2:]
    return found.where((F.col(pred) != language.UND) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, null and empty ones as one text. Repeated and null ids lose no text."""
    return dedup.keep_unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays. Repeated and null ids lose no text; documents without a word all stay."""
    return near_dups.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources get the same share of as many documents as there are, null being one of them; a document may come several times, or not at all."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and of what they decode to; a null text counts as empty."""
    return bpe_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Language identification is a trained model: no SQL gives these rows. The tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. No stage is troubled by an empty table or by columns named like its own."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
