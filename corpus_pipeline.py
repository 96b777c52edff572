"""From raw documents to token ids: the operators of ``shotbank.llm`` one after the other.

Each stage works on all rows that its predecessor kept and returns the columns of ``documents``, but for the
last, which returns the encoded texts. Between two stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotbank.llm import chosen_path, mil_quality, sp_scan, surrogates, wu_manber
from shotbank.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones of the training fold."""
    return mil_quality.keep_good(docs, mil_quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return chosen_path.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return wu_manber.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates of the same length."""
    return surrogates.rewrite(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, n_chunks, round_trip): the token ids, and whether they decode to the text.

    The ids are written first, so that a task runs the encoder or the decoder and not one Python worker for each."""
    out = sp_scan.decode(written(sp_scan.encode(docs), "encoded"))
    return out.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "n_chunks",
                      (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL can't train the classifier nor encode; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.split()[0].lower())
    return docs
