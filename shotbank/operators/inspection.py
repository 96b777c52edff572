"""Profiling, previews, point lookups and the embedding metadata projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotbank.functions.text import preview

PREVIEW_CHARS = 100
RAW_FIELDS = ("source", "target", "rationale", "task")


def head(raw: DataFrame, n: int) -> DataFrame:
    """First ``n`` records in file order (TakeOrderedAndProject: a bounded top-n)."""
    return raw.orderBy("pos").limit(n)


def profile(raw: DataFrame) -> DataFrame:
    """total_samples and the record fields, one row."""
    fields = [c for c in RAW_FIELDS if c in raw.columns]
    return raw.agg(F.count(F.lit(1)).alias("total_samples")).withColumn(
        "columns", F.lit(",".join(fields)))


def previews(triplets: DataFrame, n: int = PREVIEW_CHARS) -> DataFrame:
    """Each text shortened to ``n`` characters with ``...`` when longer."""
    return triplets.select("id", preview("question", n).alias("question_preview"),
                           preview("rationale", n).alias("rationale_preview"),
                           preview("answer", n).alias("answer_preview"))


def lookup(ids: DataFrame, vectors: DataFrame,
           columns=("question", "rationale", "answer", "source")) -> DataFrame:
    """Batch form of get-item-by-id: every requested id, metadata or NULL."""
    meta = vectors.select("id", *columns).withColumn("found", F.lit(True))
    return (ids.select("id").join(meta, "id", "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def vector_metadata(vectors: DataFrame) -> DataFrame:
    """Metadata rows beside the vectors: id defaults to the position, source to ``unknown``."""
    return vectors.select(
        F.col("pos").alias("embedding_index"),
        F.coalesce(F.col("id"), F.col("pos").cast("string")).alias("id"),
        "question", "rationale", "answer",
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
        "task",
    )
