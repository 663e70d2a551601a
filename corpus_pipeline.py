"""A corpus pipeline: language ID, toxicity, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows into
the shared folder and reads them back as the next one's docs. The classifiers learn from the labelled
rows of the tables in ``sf_dir``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import langid, lines, packing, simhash, toxicity
from evidentia.llm.common import fold, stored, table

MIN_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter, and those whose language stays unclear over their bytes.

    A score is a mean over n bytes, so two of its standard errors are at most 1 / sqrt(n): a document goes where
    its score lies below MIN_LANGUAGE_SCORE by more than that. A few bytes are too little to reject a text on.
    """
    model = langid.train(table(spark, sf_dir, "documents"), where=fold(F.col("doc_id"), 4) != 2)
    lang, score = langid.added(docs.columns)
    found = langid.predict(docs, model)
    error = 1 / F.sqrt(F.octet_length("text"))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) + error >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), where=fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model).where(F.col(toxicity.added(docs.columns)[1]) == 0).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out of the texts; documents that lose all their words go."""
    dropped = F.col(lines.counted(docs.columns)[1])
    found = lines.dedup(docs).where((dropped == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(dropped > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long")))
    return found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the smallest id's. Other groups' rows stay, whatever their ids."""
    return simhash.one_of_each(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("toxicity", toxic), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("packing", pack)]

#: The classifiers and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
