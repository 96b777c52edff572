"""Raw records -> clean (question, rationale, answer) triplets.

Rules, applied in this order (they are the reference's behaviour):
1. a field counts only if present and non-empty (the reader maps every other
   falsy JSON value - 0, false, [], {} , null - to NULL before this step);
2. strip whitespace at both ends (Python's 29 whitespace code points);
3. drop the row if question, rationale or answer is missing or empty;
4. drop it if question < 3, rationale < 10 or answer < 1 code points long,
   measured after strip, before collapse;
5. collapse every whitespace run to one space in all kept fields, task too;
6. id = the record key, source = a constant provenance label.

``task`` is kept whenever the record has the key; a null task becomes "None".
Everything is one narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotbank.functions.text import collapse, strip

# Length limits, counted after strip and before collapse, and the
# provenance label stamped on every triplet.
MIN_QUESTION, MIN_RATIONALE, MIN_ANSWER = 3, 10, 1
DEFAULT_PROVENANCE = "cot_collection"


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with its columns yielded by a one-row generator."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def classify(raw: DataFrame) -> DataFrame:
    """The raw columns plus stripped fields, the list of missing fields and a ``status``.

    ``raw`` needs pos, id, source, target, rationale and task; an optional
    boolean ``has_task`` says whether the record had the task key (default: yes).
    """
    has_task = F.col("has_task") if "has_task" in raw.columns else F.lit(True)
    # a generator is a wall for filter pushdown: what it yields is computed once per row, not once per test
    raw = _once(raw, *raw.columns)
    q = F.when(_present(F.col("source")), strip("source"))
    r = F.when(_present(F.col("rationale")), strip("rationale"))
    a = F.when(_present(F.col("target")), strip("target"))
    t = F.when(has_task, strip(F.coalesce(F.col("task"), F.lit("None"))))
    df = _once(raw.select("*", q.alias("_q"), r.alias("_r"), a.alias("_a"), t.alias("_t")), *raw.columns, "_q", "_r", "_a", "_t")
    missing = F.array_compact(F.array(
        F.when(~_present(F.col("_q")), F.lit("question")),
        F.when(~_present(F.col("_r")), F.lit("rationale")),
        F.when(~_present(F.col("_a")), F.lit("answer")),
    ))
    short = ((F.length("_q") < MIN_QUESTION) | (F.length("_r") < MIN_RATIONALE)
             | (F.length("_a") < MIN_ANSWER))
    status = (F.when(F.size(missing) > 0, F.lit("missing"))
              .when(short, F.lit("too_short")).otherwise(F.lit("kept")))
    return df.withColumn("missing_fields", missing).withColumn("status", status)


def extract_triplets(raw: DataFrame, provenance: str = DEFAULT_PROVENANCE) -> DataFrame:
    """Kept rows as (pos, id, question, rationale, answer, task, source)."""
    return (classify(raw).where(F.col("status") == "kept")
            .select("pos", "id",
                    collapse("_q").alias("question"),
                    collapse("_r").alias("rationale"),
                    collapse("_a").alias("answer"),
                    collapse("_t").alias("task"),
                    F.lit(provenance).alias("source")))


def triplet_rejects(raw: DataFrame) -> DataFrame:
    """Dropped rows with the reason and the lengths the length test saw."""
    return (classify(raw).where(F.col("status") != "kept")
            .select("pos", "id", F.col("status").alias("reason"),
                    F.array_join("missing_fields", ",").alias("missing_fields"),
                    F.length("_q").alias("question_len"),
                    F.length("_r").alias("rationale_len"),
                    F.length("_a").alias("answer_len")))


def extraction_rate(raw: DataFrame) -> DataFrame:
    """One row: total, kept, dropped by reason and kept / total * 100."""
    c = classify(raw)
    return c.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "kept").alias("kept"),
        F.count_if(F.col("status") == "missing").alias("dropped_missing"),
        F.count_if(F.col("status") == "too_short").alias("dropped_short"),
    ).withColumn("success_rate",
                 F.round(F.try_divide(F.col("kept") * 100.0, F.col("total")), 6))
