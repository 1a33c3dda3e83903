"""A corpus cleaned in stages, each written as Parquet and read again as the next one's documents.

toxicity (what the classifier rejects goes), exact copies (one of each group stays), near copies (five-word shingles,
similarity 0.8: one of each group stays), benchmark leaks (documents that hold an item go), SentencePiece ids (added to
what is left). Each stage works on all rows and whole texts that its predecessor kept; all but the last return the
columns of documents, whatever others there are and whatever they are called.

Defined results: a null text is an empty one, and stays null in the rows that are kept; rows with empty texts are copies
of each other, so one of them stays, and near copies of nothing; very long texts are read whole; of rows that tie (equal
texts with one id, or rows repeated in full) exactly one stays; a null id comes after all others; an empty table gives an
empty result with the columns of the last stage; without labels of both kinds nothing is toxic, without items nothing
leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelmill.llm import decontaminate, exact_dedup, jaccard_join, pieces, shared, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; the classifier learns from the labelled ones outside its held-out fold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest original and then the least doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the least doc_id stays."""
    return jaccard_join.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with token_ids and whether both libraries agree on them."""
    return pieces.encode(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("jaccard_join", drop_near_copies), ("decontaminate", drop_leaks), ("sentencepiece", encode)]
ORACLE_SQL = None  # the classifier's training is not SQL; tests compare run() with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    since = shared.tables_made()
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        shared.sweep(spark, since, docs)  # what the stage and its predecessor wrote
    return docs
