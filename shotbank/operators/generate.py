"""Prompt assembly, batch generation through a pluggable model, comparison and evaluation.

The model is a user callable ``model(system, prompt) -> str`` run inside
``mapInArrow``: one Python call per prompt (a model call is the unit of work),
each isolated by try/except so one failure becomes an ``Error: ...`` response
instead of failing the job. Generation is neither cheap nor repeatable, so
``generate_to`` writes the result once and everything downstream reads it.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotbank.session import ship_package

MAX_EXAMPLES = 5
DEFAULT_K = 5

# Method labels, system texts and prompt templates.
BASELINE, COT = "baseline", "retrieval_augmented_cot"
BASELINE_SYSTEM = ("You are a helpful assistant that provides direct, concise answers "
                   "without showing reasoning steps.")
COT_SYSTEM = ("You are a helpful assistant that thinks step-by-step and shows detailed "
              "reasoning before providing the final answer.")
QUESTION_HEAD = "Question: "
BASELINE_TAIL = "\n\nGive me the final answer only."
EXAMPLE_PARTS = ("Example ", ":\nQuestion: ", "\nRationale: ", "\nAnswer: ", "\n\n")
COT_TAIL = "Now think step by step to solve the question above."
COT_FALLBACK_TAIL = "\n\nThink step by step to solve this question."
REPORT_RULE = "=" * 80
REPORT_QUERY = "QUERY: "
REPORT_BASELINE = "\n📍 BASELINE APPROACH:"
REPORT_PROMPT, REPORT_RESPONSE, REPORT_TIME = "Prompt: ", "Response: ", "Time: %.3fs"
REPORT_COT = "\n🧠 RETRIEVAL-AUGMENTED CoT APPROACH:"
REPORT_FULL_PROMPT = "Full Prompt: "
REPORT_ERROR = ("Error processing query '", "': ")
ERROR_PREFIX = "Error: "
NO_VALID = "No valid comparisons to evaluate"

Model = Callable[[str, str], str]


def baseline_prompts(queries: DataFrame) -> DataFrame:
    """(query_id, method, query, system, prompt) asking for the final answer only."""
    return queries.select(
        "query_id", F.lit(BASELINE).alias("method"), "query",
        F.lit(BASELINE_SYSTEM).alias("system"),
        F.concat(F.lit(QUESTION_HEAD), F.col("query"), F.lit(BASELINE_TAIL)).alias("prompt"))


def _example_text(e: Column) -> Column:
    p = EXAMPLE_PARTS
    field = lambda name: F.coalesce(e[name].cast("string"), F.lit(""))
    return F.concat(F.lit(p[0]), field("rank"), F.lit(p[1]), field("question"),
                    F.lit(p[2]), field("rationale"), F.lit(p[3]), field("answer"), F.lit(p[4]))


def example_lists(hits: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(query_id, examples): up to ``max_examples`` hits per query as an ordered array."""
    ex = F.struct(F.col("rank").cast("int").alias("rank"), F.col("score").alias("score"), "id",
                  "question", "rationale", "answer")
    return (hits.where(F.col("rank") <= max_examples).groupBy("query_id")
            .agg(F.array_sort(F.collect_list(ex)).alias("examples")))


def cot_prompts(queries: DataFrame, hits: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(query_id, method, query, system, prompt, examples) with the retrieved examples
    (answers included) between the question and the instruction."""
    ex = example_lists(hits, max_examples)
    joined = queries.select("query_id", "query").join(ex, "query_id", "left")
    has = F.coalesce(F.size("examples"), F.lit(0)) > 0
    body = F.array_join(F.transform("examples", _example_text), "")
    prompt = F.when(has, F.concat(F.lit(QUESTION_HEAD), F.col("query"), F.lit("\n\n"), body, F.lit(COT_TAIL))) \
        .otherwise(F.concat(F.lit(QUESTION_HEAD), F.col("query"), F.lit(COT_FALLBACK_TAIL)))
    return joined.select("query_id", F.lit(COT).alias("method"), "query",
                         F.lit(COT_SYSTEM).alias("system"), prompt.alias("prompt"), "examples")


def _call_all(model: Model, schema: T.StructType):
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        for rb in batches:
            responses, times, failed = [], [], []
            for system, prompt in zip(rb.column("system").to_pylist(), rb.column("prompt").to_pylist()):
                start = time.perf_counter()
                try:
                    text, bad = str(model(system, prompt)).strip(), False
                except Exception as e:  # noqa: BLE001 - one failed call must not fail the batch
                    text, bad = f"{ERROR_PREFIX}{e}", True
                times.append(time.perf_counter() - start)
                responses.append(text)
                failed.append(bad)
            # all other columns pass through as Arrow arrays
            yield pa.RecordBatch.from_arrays(
                [*rb.columns, pa.array(responses, pa.string()), pa.array(times, pa.float64()), pa.array(failed, pa.bool_())],
                schema=out_schema)
    return run


def generate(prompts: DataFrame, model: Model, parallelism: int | None = None) -> DataFrame:
    """(query_id, method, query, system, prompt[, examples], response, generation_time, failed).

    ``parallelism`` caps concurrent model calls (partitions), e.g. for a rate
    limited service; otherwise the input partitioning is kept (no shuffle).
    """
    ship_package(prompts.sparkSession)
    cols = prompts.select("query_id", "method", "query", "system", "prompt",
                          *[c for c in ("examples",) if c in prompts.columns])
    if parallelism:
        cols = cols.repartition(parallelism, "query_id")
    schema = T.StructType([*cols.schema.fields, T.StructField("response", T.StringType()),
                           T.StructField("generation_time", T.DoubleType()), T.StructField("failed", T.BooleanType())])
    return cols.mapInArrow(_call_all(model, schema), schema)


def generate_to(prompts: DataFrame, model: Model, path: str, parallelism: int | None = None) -> DataFrame:
    """Generate once, write Parquet, return the written table (cuts the lineage)."""
    generate(prompts, model, parallelism).write.mode("overwrite").parquet(path)
    return prompts.sparkSession.read.parquet(path)


def patient(model: Model, retries: int, backoff: float) -> Model:
    """``model``, called again after a failure, up to ``retries`` times, after pauses that double from ``backoff`` seconds."""

    def call(system: str, prompt: str):
        for again in range(retries + 1):
            try:
                return model(system, prompt)
            except Exception:  # noqa: BLE001 - the last one is the caller's
                if again == retries:
                    raise
                time.sleep(backoff * 2 ** again)

    return call


def generate_resumable(prompts: DataFrame, model: Model, path: str, calls_per_commit: int = 32, retries: int = 2,
                       backoff: float = 1.0) -> DataFrame:
    """Like :func:`generate_to`, but what a killed run had finished is kept, and a run on the same ``path`` goes on from there.

    Prompts are dealt into tasks of about ``calls_per_commit`` calls; a task's answers are committed when it ends,
    whatever becomes of the job (the second commit algorithm). The next run leaves out every prompt that has an answer
    already; one whose calls all failed is asked again. A prompt is known by its query_id, method, system and prompt; repeated rows
    are asked once. Returns one answer per prompt of ``prompts``.
    """
    spark = prompts.sparkSession
    key = ["query_id", "method", "system", "prompt"]
    asked = prompts.dropDuplicates(key)
    done = answers(spark, path)
    if done is not None:
        good = done.where(~F.col("failed")).select(*(F.col(k).alias("_" + k) for k in key))
        asked = asked.join(good, [F.col(k).eqNullSafe(F.col("_" + k)) for k in key], "left_anti")
    rest = asked.count()
    if rest:
        generate(asked, patient(model, retries, backoff), math.ceil(rest / calls_per_commit)).write.mode("append").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    done = answers(spark, path)
    if done is None:
        return generate(prompts.limit(0), model)
    wanted = prompts.select(*(F.col(k).alias("_" + k) for k in key))
    return done.join(wanted, [F.col(k).eqNullSafe(F.col("_" + k)) for k in key], "left_semi")


def answers(spark: SparkSession, path: str) -> DataFrame | None:
    """One answer per prompt of those committed under ``path``, a good one if there is one; None if nothing is there."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:  # no folder, or no file in it
        return None
    first = Window.partitionBy("query_id", "method", "system", "prompt").orderBy("failed", "response")
    return found.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")


def best_scores(hits: DataFrame) -> DataFrame:
    """(query_id, best_similarity_score, retrieved_examples_count) from kept hits."""
    return hits.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best_similarity_score"),
        F.count(F.lit(1)).alias("retrieved_examples_count"))


def compare_methods(generations: DataFrame, best: DataFrame | None = None,
                    keys: tuple[str, ...] = ("query_id",),
                    expected: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """One row per key pairing the two methods, with an ``error`` text instead of numbers where a key
    has only one of them (or, with ``failed``, where its comparison raised).

    The keys are those of ``generations``, ``expected`` and ``failed``. ``best`` adds retrieved_examples_count
    (0 when absent) and the nullable best_similarity_score. The query stays on error rows, from ``expected``
    where nothing was generated. All inputs are tagged, put together and aggregated by key once (one
    exchange); only numbers are aggregated, and the two methods' texts are joined to the result.
    """
    blank = {"m": F.lit(None).cast("string"), "t": F.lit(None).cast("double"), "bad": F.lit(None).cast("boolean"),
             "s": F.lit(None).cast("double"), "n": F.lit(None).cast("long")}

    def tagged(df: DataFrame, **cols) -> DataFrame:
        return df.select(*keys, *[{**blank, **cols}[c].alias(f"_{c}") for c in blank])

    rows = tagged(generations, m=F.col("method"), t=F.col("generation_time"))
    if best is not None:
        rows = rows.unionByName(tagged(best, s=F.col("best_similarity_score"), n=F.col("retrieved_examples_count").cast("long")))
    if expected is not None:
        rows = rows.unionByName(tagged(expected, bad=F.lit(False)))
    if failed is not None:
        rows = rows.unionByName(tagged(failed, bad=F.lit(True)))
    time_of = lambda method: F.max(F.when(F.col("_m") == method, F.col("_t")))
    agg = [time_of(BASELINE).alias("baseline_time"), time_of(COT).alias("cot_time"),
           F.max("_bad").alias("_bad"), F.max(F.col("_m").isNotNull()).alias("_any")]
    if best is not None:
        agg += [F.max("_s").alias("best_similarity_score"), F.coalesce(F.max("_n"), F.lit(0)).alias("retrieved_examples_count")]
    out = rows.groupBy(*keys).agg(*agg)
    out = out.where(F.col("_any") | F.col("_bad").isNotNull())  # a best score alone asks nothing
    error = (F.when(F.col("_bad"), F.lit("comparison failed"))
             .when(F.col("baseline_time").isNull(), F.lit("missing baseline result"))
             .when(F.col("cot_time").isNull(), F.lit("missing retrieval_augmented_cot result")))
    out = out.withColumn("error", error).withColumn("time_difference", F.col("cot_time") - F.col("baseline_time"))
    values = ["baseline_time", "cot_time", "time_difference",
              *(["best_similarity_score", "retrieved_examples_count"] if best is not None else [])]
    out = out.select(*keys, "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in values])
    return _with_texts(out, generations, keys, expected)


def _with_texts(out: DataFrame, generations: DataFrame, keys: tuple[str, ...], expected: DataFrame | None) -> DataFrame:
    """The methods' texts beside their times, where ``generations`` carries texts."""
    if "prompt" not in generations.columns:
        return out
    per = ["prompt", "response"] + [c for c in ("examples",) if c in generations.columns]
    for method, short in ((BASELINE, "baseline"), (COT, "cot")):
        cols = [F.col(c).alias(f"{short}_{c}") for c in per if not (c == "examples" and method == BASELINE)]
        text = generations.where(F.col("method") == method).select(*keys, F.col("query").alias(f"_{short}"), *cols)
        out = out.join(text.dropDuplicates(list(keys)), list(keys), "left")
    asked = [F.col("_baseline"), F.col("_cot")]
    if expected is not None and "query" in expected.columns:
        names = expected.select(*keys, F.col("query").alias("_asked")).dropDuplicates(list(keys))
        out, asked = out.join(names, list(keys), "left"), [*asked, F.col("_asked")]
    texts = [c for c in out.columns if c.startswith(("baseline_", "cot_")) and not c.endswith("_time")]
    rest = [c for c in out.columns if c not in texts and not c.startswith("_") and c not in (*keys, "error")]
    return out.select(*keys, F.coalesce(*asked).alias("query"), "error", *rest,
                      *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in texts])


def evaluate(comparisons: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Run metrics over comparisons without an error (one row).

    retrieval_success_rate is kept as defined (share of rows with a best
    score, 1.0 whenever the index is non-empty because of the top-1 fallback);
    above_threshold_rate beside it counts best scores >= ``threshold``.
    """
    if "error" in comparisons.columns:
        valid = comparisons.withColumn("_ok", F.col("error").isNull())
    else:
        valid = comparisons.withColumn("_ok", F.lit(True))
    n = F.count_if("_ok")
    m = valid.agg(
        F.count(F.lit(1)).alias("_seen"),  # errors too, which carry no numbers
        n.alias("total_queries"),
        F.avg("baseline_time").alias("average_baseline_time"),
        F.avg("cot_time").alias("average_cot_time"),
        F.try_divide(F.sum("cot_time") - F.sum("baseline_time"), n).alias("average_time_overhead"),
        F.coalesce(F.avg("best_similarity_score"), F.lit(0.0)).alias("average_similarity_score"),
        F.try_divide(F.count("best_similarity_score").cast("double"), n).alias("retrieval_success_rate"),
        F.try_divide(F.count_if(F.col("best_similarity_score") >= threshold).cast("double"), n)
        .alias("above_threshold_rate"),
    )
    # empty input has no metrics and no error; input of errors only says so
    return m.withColumn("error", F.when((F.col("total_queries") == 0) & (F.col("_seen") > 0), F.lit(NO_VALID))).drop("_seen")


def report(comparisons: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys..., report): the readable comparison text, or the error line."""
    t = lambda c: F.format_string(REPORT_TIME, F.col(c))
    text = F.concat_ws(
        "\n", F.lit(REPORT_RULE), F.concat(F.lit(REPORT_QUERY), F.col("query")), F.lit(REPORT_RULE),
        F.lit(REPORT_BASELINE),
        F.concat(F.lit(REPORT_PROMPT), F.col("baseline_prompt")),
        F.concat(F.lit(REPORT_RESPONSE), F.col("baseline_response")), t("baseline_time"),
        F.lit(REPORT_COT),
        F.concat(F.lit(REPORT_FULL_PROMPT), F.col("cot_prompt")),
        F.concat(F.lit(REPORT_RESPONSE), F.col("cot_response")), t("cot_time"))
    if "error" not in comparisons.columns:
        return comparisons.select(*keys, text.alias("report"))
    err = F.concat(F.lit(REPORT_ERROR[0]), F.coalesce(F.col("query"), F.lit("")),
                   F.lit(REPORT_ERROR[1]), F.col("error"))
    return comparisons.select(*keys, F.when(F.col("error").isNotNull(), err).otherwise(text).alias("report"))


def echo_model(system: str, prompt: str) -> str:
    """Deterministic stand-in model for tests and benches: repeats the first prompt line."""
    return prompt.split("\n", 1)[0]
