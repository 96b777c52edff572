"""Retrieval over a knowledge base: search, threshold with fallback, text rendering.

All functions take whole tables of queries; per-query text is built with
ordered aggregation over at most ``k`` hits per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotbank.operators.knn import attach, knn

DEFAULT_K = 1
DEFAULT_THRESHOLD = 0.5
PROMPT_MIN_K = 5
PROMPT_MAX_EXAMPLES = 5
META_COLUMNS = ("question", "rationale", "answer", "task", "source")

# Rendering texts (per hit, lines in this order, each ending in a newline).
SIMPLE_HEAD = "Example %d (similarity: %.4f):"
SIMPLE_FIELDS = (("  Question: ", "question"), ("  Rationale: ", "rationale"), ("  Answer: ", "answer"))
DETAILED_HEAD = "=== Retrieved Example %d ==="
DETAILED_SCORE = "Similarity Score: %.4f"
DETAILED_FIELDS = (("Source: ", "source"), ("ID: ", "id"), ("Question: ", "question"),
                   ("Rationale: ", "rationale"), ("Answer: ", "answer"))
UNKNOWN = "unknown"
PROMPT_HEAD = "Example %d:"
PROMPT_FIELDS = (("Question: ", "question"), ("Rationale: ", "rationale"))
PROMPT_HEADER = "Here are examples demonstrating how to think step-by-step:\n\n"
PROMPT_FOOTER = "---\n\nNow, solve the following problem using the same step-by-step thinking:"
FORMAT_TYPES = ("simple", "detailed", "prompt")


def similarity(score: Column, metric: str) -> Column:
    """Score as a similarity; for squared L2 between unit vectors cos = 1 - d/2."""
    return (F.lit(1.0) - score / 2.0) if metric == "l2" else score


def apply_threshold(hits: DataFrame, threshold: float | None, metric: str = "ip") -> DataFrame:
    """Keep hits with similarity >= threshold; a query left with none keeps its best.

    Ranks come from descending similarity, so the survivors are a prefix of the
    ranking and ``rank = 1`` is the single best hit: one narrow filter.
    """
    if threshold is None or threshold <= 0:
        return hits
    return hits.where((similarity(F.col("score"), metric) >= F.lit(float(threshold)))
                      | (F.col("rank") == 1))


def retrieve(queries: DataFrame, vectors: DataFrame, k: int | None = None,
             threshold: float | None = DEFAULT_THRESHOLD, metric: str = "ip",
             return_scores: bool = True, with_metadata: bool = True,
             query_vec: str = "embedding", vector_col: str = "embedding",
             search=None, **knn_options) -> DataFrame:
    """(query_id, rank, id, score[, metadata]) for every query of the batch.

    ``search(queries, k, info)`` replaces the exact search over ``vectors`` (e.g. by an index)."""
    k = DEFAULT_K if k is None else k
    info: dict = {}
    if search is not None:
        hits = search(queries, k, info)
    else:
        hits = knn(queries, vectors, k, metric, query_vec=query_vec, corpus_vec=vector_col,
                   info=info, **knn_options)
    hits = apply_threshold(hits, threshold, metric)
    if with_metadata:
        cols = tuple(c for c in META_COLUMNS if c in vectors.columns)
        hits = attach(hits, vectors, columns=cols, max_rows=info.get("max_hits"))
        hits = hits.select("query_id", "rank", "id", "score", *cols)
    if not return_scores:
        hits = hits.drop("score")
    return hits


def _ordered_join(block: Column, sep: str = "\n") -> Column:
    """Blocks of one query joined in rank order (sort on a struct led by rank)."""
    items = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), block.alias("b"))))
    return F.array_join(F.transform(items, lambda x: x["b"]), sep)


def _lines(fields, defaults=()) -> list[Column]:
    out = []
    for label, col in fields:
        # a missing field leaves its line empty (or "unknown"), never the whole example out
        value = F.coalesce(F.col(col).cast("string"), F.lit(UNKNOWN if col in defaults else ""))
        out += [F.lit(label), value, F.lit("\n")]
    return out


def _simple_block() -> Column:
    return F.concat(F.format_string(SIMPLE_HEAD, F.col("rank"), F.col("score")), F.lit("\n"),
                    *_lines(SIMPLE_FIELDS))


def _detailed_block() -> Column:
    return F.concat(F.format_string(DETAILED_HEAD, F.col("rank")), F.lit("\n"),
                    F.format_string(DETAILED_SCORE, F.col("score")), F.lit("\n"),
                    *_lines(DETAILED_FIELDS, defaults=("source", "id")))


def _prompt_block() -> Column:
    return F.concat(F.format_string(PROMPT_HEAD, F.col("rank")), F.lit("\n"), *_lines(PROMPT_FIELDS))


def format_hits(hits: DataFrame, format_type: str = "simple") -> DataFrame:
    """(query_id, text): the retrieved examples of each query rendered as one text."""
    if format_type == "simple":
        block = _simple_block()
    elif format_type == "detailed":
        block = _detailed_block()
    elif format_type == "prompt":
        hits = hits.where(F.col("rank") <= PROMPT_MAX_EXAMPLES)
        block = _prompt_block()
    else:
        raise ValueError(f"Unknown format type: {format_type}")
    text = _ordered_join(block)
    if format_type == "prompt":
        text = F.concat(F.lit(PROMPT_HEADER), text, F.lit(PROMPT_FOOTER))
    return hits.groupBy("query_id").agg(text.alias("text"))


def retrieve_and_format(queries: DataFrame, vectors: DataFrame, k: int | None = None,
                        format_type: str = "simple", threshold: float | None = DEFAULT_THRESHOLD,
                        metric: str = "ip", **knn_options) -> DataFrame:
    """(query_id, text) for every query; a query without hits gets ``""``."""
    if format_type not in FORMAT_TYPES:
        raise ValueError(f"Unknown format type: {format_type}")
    if format_type == "prompt" and (k is None or k < PROMPT_MIN_K):
        k = PROMPT_MIN_K
    hits = retrieve(queries, vectors, k=k, threshold=threshold, metric=metric, **knn_options)
    texts = format_hits(hits, format_type)
    return (queries.select("query_id").distinct().join(texts, "query_id", "left")
            .select("query_id", F.coalesce("text", F.lit("")).alias("text")))
