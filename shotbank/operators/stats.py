"""Statistics over triplets, vectors, indexes and retrieval results.

Every function is a single distributed aggregate (partial aggregation on the
map side, one small exchange); none collects rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotbank.functions.vectors import norm

# Relevance bands of a similarity score.
BAND_HIGH, BAND_MEDIUM = 0.7, 0.5
TOP_TASKS = 10


def triplet_stats(triplets: DataFrame) -> DataFrame:
    """total_triplets and the mean length of question, rationale and answer."""
    return triplets.agg(
        F.count(F.lit(1)).alias("total_triplets"),
        F.avg(F.length("question")).alias("avg_question_length"),
        F.avg(F.length("rationale")).alias("avg_rationale_length"),
        F.avg(F.length("answer")).alias("avg_answer_length"),
    )


def embedding_stats(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Count, dimension, mean and population standard deviation of the norms."""
    normed = vectors.select(norm(vec).alias("_n"), F.size(vec).alias("_d"))
    return normed.agg(
        F.count(F.lit(1)).alias("num_embeddings"),
        F.max("_d").alias("embedding_dimension"),
        F.avg("_n").alias("mean_norm"),
        F.stddev_pop("_n").alias("std_norm"),
    )


def dimension_check(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """The data's dimension; ``consistent`` is false when sizes differ."""
    return vectors.agg(
        F.count(vec).alias("num_vectors"),
        F.min(F.size(vec)).alias("min_dimension"),
        F.max(F.size(vec)).alias("max_dimension"),
    ).withColumn("consistent", F.col("min_dimension") == F.col("max_dimension"))


def assert_dimension(vectors: DataFrame, vec: str = "embedding") -> int:
    """Raise when a vector table mixes dimensions; return the dimension."""
    row = dimension_check(vectors, vec).first()
    if row["num_vectors"] and not row["consistent"]:
        raise ValueError(f"mixed vector dimensions: {row['min_dimension']}..{row['max_dimension']}")
    return int(row["max_dimension"] or 0)


def task_distribution(triplets: DataFrame) -> DataFrame:
    """(task, count): records per task, a missing task counted as ``unknown``."""
    return (triplets.groupBy(F.coalesce(F.col("task"), F.lit("unknown")).alias("task"))
            .agg(F.count(F.lit(1)).alias("count")))


def task_count(triplets: DataFrame) -> DataFrame:
    """Number of distinct tasks (missing = ``unknown``) and of triplets, one row."""
    t = F.coalesce(F.col("task"), F.lit("unknown"))
    return triplets.agg(F.count_distinct(t).alias("distinct_tasks"), F.count(F.lit(1)).alias("triplets"))


def task_topk(triplets: DataFrame, n: int = TOP_TASKS) -> DataFrame:
    """The ``n`` most frequent tasks, ties by task name (a top-n report)."""
    return task_distribution(triplets).orderBy(F.col("count").desc(), F.col("task").asc()).limit(n)


def corpus_compare(corpora: dict[str, DataFrame]) -> DataFrame:
    """triplet_stats per named corpus, side by side (one union, one aggregate)."""
    parts = [df.select(F.lit(name).alias("corpus"), "question", "rationale", "answer")
             for name, df in corpora.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("total_triplets"),
        F.avg(F.length("question")).alias("avg_question_length"),
        F.avg(F.length("rationale")).alias("avg_rationale_length"),
        F.avg(F.length("answer")).alias("avg_answer_length"),
    )


def relevance_band(score) -> F.Column:
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s >= BAND_HIGH, F.lit("high"))
            .when(s >= BAND_MEDIUM, F.lit("medium")).otherwise(F.lit("low")))


def relevance_bands(hits: DataFrame) -> DataFrame:
    """Hits per relevance band with their mean score."""
    return (hits.groupBy(relevance_band("score").alias("band"))
            .agg(F.count(F.lit(1)).alias("hits"), F.avg("score").alias("avg_score")))


def index_stats(index: DataFrame, index_type: str, vec: str = "embedding",
                cell: str | None = None) -> DataFrame:
    """Vectors, dimension, type, trained flag, metadata rows and cell count."""
    aggs = [F.count(F.lit(1)).alias("total_vectors"),
            F.max(F.size(vec)).alias("dimension"),
            F.count("question").alias("num_metadata_items")]
    if cell:
        aggs.append(F.count_distinct(cell).alias("num_cells"))
    out = index.agg(*aggs).withColumn("index_type", F.lit(index_type)).withColumn("is_trained", F.lit(True))
    if not cell:
        out = out.withColumn("num_cells", F.lit(0).cast("long"))
    return out
