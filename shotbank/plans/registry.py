"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame computed over
the whole driver tables. Published doubles are rounded to 6 places on both
sides; formatted texts use the unrounded scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotbank.operators import clean, knn as knn_op, pivot, retrieve as ret
from shotbank.plans import oracle as O
from shotbank.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df


# ------------------------------------------------------------------ corpus

@register("triplets", O.with_base(
    "x as (select 1) select pos, id, question, rationale, answer, task, source from triplets", kb=False))
def q_triplets(spark, sf):
    return fx.build_triplets(spark, sf)


_REJECTS_SQL = """rej as (
  select pos, id, status as reason,
         concat_ws(',', case when coalesce(q, '') = '' then 'question' end,
                        case when coalesce(r, '') = '' then 'rationale' end,
                        case when coalesce(a, '') = '' then 'answer' end) as missing_fields,
         cast(length(q) as integer) as question_len, cast(length(r) as integer) as rationale_len,
         cast(length(a) as integer) as answer_len
  from classified where status <> 'kept')"""


@register("triplets_missing", O.with_base(_REJECTS_SQL + " select * from rej where reason = 'missing'", kb=False))
def q_triplets_missing(spark, sf):
    return clean.triplet_rejects(fx.corpus_raw(spark, sf)).where(F.col("reason") == "missing")


@register("triplets_short", O.with_base(_REJECTS_SQL + " select * from rej where reason = 'too_short'", kb=False))
def q_triplets_short(spark, sf):
    return clean.triplet_rejects(fx.corpus_raw(spark, sf)).where(F.col("reason") == "too_short")


@register("extraction_rate", O.with_base("""x as (select 1)
select count(*) as total, cast(count_if(status = 'kept') as bigint) as kept,
       cast(count_if(status = 'missing') as bigint) as dropped_missing,
       cast(count_if(status = 'too_short') as bigint) as dropped_short,
       round(cast(count_if(status = 'kept') as double) * 100 / count(*), 6) as success_rate
from classified""", kb=False))
def q_extraction_rate(spark, sf):
    return clean.extraction_rate(fx.corpus_raw(spark, sf))


# ------------------------------------------------------------------ search

_META = "kb.question, kb.rationale, kb.answer, kb.task, kb.source"


@register("knn_ip", O.with_base(O.knn_hits(5) + "\nselect query_id, rank, id, round(score, 6) as score from hits"))
def q_knn_ip(spark, sf):
    hits = knn_op.knn(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf), 5, "ip")
    return r6(hits, "score")


@register("knn_blocked", O.with_base(
    O.knn_hits(3, queries="(select pos as query_id, embedding from kb)")
    + "\nselect query_id, rank, id, round(score, 6) as score from hits"))
def q_knn_blocked(spark, sf):
    """Every vector as a query, both sides dealt by pivots."""
    kb = fx.knowledge_base(spark, sf)
    return r6(pivot.knn_join(kb.select(F.col("pos").alias("query_id"), "embedding"), kb, 3, "ip"), "score")


@register("knn_l2", O.with_base(O.knn_hits(5, "l2") + "\nselect query_id, rank, id, round(score, 6) as score from hits"))
def q_knn_l2(spark, sf):
    hits = knn_op.knn(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf), 5, "l2")
    return r6(hits, "score")


@register("self_knn", O.with_base(
    O.knn_hits(3, queries="(select pos as query_id, embedding from kb)")
    + "\nselect query_id, rank, id, round(score, 6) as score from hits"))
def q_self_knn(spark, sf):
    return r6(knn_op.self_knn(fx.knowledge_base(spark, sf), 3, "ip", query_id="pos"), "score")


@register("knn_with_metadata", O.with_base(O.knn_hits(3) + f"""
select h.query_id, h.rank, h.id, round(h.score, 6) as score, {_META}
from hits h join kb on kb.id = h.id"""))
def q_knn_with_metadata(spark, sf):
    hits = ret.retrieve(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf), k=3, threshold=0)
    return r6(hits, "score")


@register("retrieve", O.with_base(O.knn_hits(1) + f"""
select h.query_id, h.rank, h.id, round(h.score, 6) as score, {_META}
from hits h join kb on kb.id = h.id"""))
def q_retrieve(spark, sf):
    # the reference's defaults: k = 1, threshold = 0.5
    hits = ret.retrieve(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf))
    return r6(hits, "score")


@register("retrieve_threshold", O.with_base(O.knn_hits(5) + f"""
select h.query_id, h.rank, h.id, round(h.score, 6) as score, {_META}
from hits h join kb on kb.id = h.id where h.score >= 0.35 or h.rank = 1"""))
def q_retrieve_threshold(spark, sf):
    hits = ret.retrieve(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf), k=5, threshold=0.35)
    return r6(hits, "score")


@register("retrieve_no_scores", O.with_base(O.knn_hits(3) + f"""
select h.query_id, h.rank, h.id, {_META}
from hits h join kb on kb.id = h.id where h.score >= 0.35 or h.rank = 1"""))
def q_retrieve_no_scores(spark, sf):
    return ret.retrieve(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf), k=3,
                        threshold=0.35, return_scores=False)


def _format_sql(k: int, block: str, prompt: bool = False) -> str:
    text = "string_agg(b, chr(10) order by rank)"
    if prompt:
        text = ("'Here are examples demonstrating how to think step-by-step:' || chr(10) || chr(10) || "
                + text + " || '---' || chr(10) || chr(10) || "
                "'Now, solve the following problem using the same step-by-step thinking:'")
    return O.with_base(O.knn_hits(k) + f""",
sel as (select h.*, {_META} from hits h join kb on kb.id = h.id where h.score >= 0.35 or h.rank = 1),
blocks as (select query_id, rank, {block} as b from sel{' where rank <= 5' if prompt else ''}),
agg as (select query_id, {text} as text from blocks group by query_id)
select q.query_id, coalesce(agg.text, '') as text from qb q left join agg on agg.query_id = q.query_id""")


_NL = " || chr(10) || "


@register("format_simple", _format_sql(3, _NL.join([
    "printf('Example %d (similarity: %.4f):', rank, score)", "'  Question: ' || question",
    "'  Rationale: ' || rationale", "'  Answer: ' || answer", "''"])))
def q_format_simple(spark, sf):
    return ret.retrieve_and_format(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf),
                                   k=3, format_type="simple", threshold=0.35)


@register("format_detailed", _format_sql(3, _NL.join([
    "printf('=== Retrieved Example %d ===', rank)", "printf('Similarity Score: %.4f', score)",
    "'Source: ' || coalesce(source, 'unknown')", "'ID: ' || coalesce(id, 'unknown')",
    "'Question: ' || question", "'Rationale: ' || rationale", "'Answer: ' || answer", "''"])))
def q_format_detailed(spark, sf):
    return ret.retrieve_and_format(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf),
                                   k=3, format_type="detailed", threshold=0.35)


@register("format_prompt", _format_sql(5, _NL.join([
    "printf('Example %d:', rank)", "'Question: ' || question", "'Rationale: ' || rationale", "''"]),
    prompt=True))
def q_format_prompt(spark, sf):
    return ret.retrieve_and_format(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf),
                                   format_type="prompt", threshold=0.35)


# ------------------------------------------------------------------ statistics and inspection

from shotbank.functions import vectors as V  # noqa: E402
from shotbank.operators import inspection as insp, stats  # noqa: E402

_AVG_LENS = """round(avg(length(question)), 6) as avg_question_length,
       round(avg(length(rationale)), 6) as avg_rationale_length,
       round(avg(length(answer)), 6) as avg_answer_length"""


@register("triplet_stats", O.with_base(f"""x as (select 1)
select count(*) as total_triplets, {_AVG_LENS} from triplets""", kb=False))
def q_triplet_stats(spark, sf):
    return r6(stats.triplet_stats(fx.triplets(spark, sf)),
              "avg_question_length", "avg_rationale_length", "avg_answer_length")


_CONV_RAW = """conv_raw as (
  select u.conv_id * 1000000 + u.turn as pos, cast(u.conv_id as varchar) || '-' || cast(u.turn as varchar) as id,
         u.text as source, split_part(a.text, chr(10), -1) as target, a.text as rationale,
         'conversation' as task
  from conversations u join conversations a
    on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  where u.role = 'user')"""


def _classify_sql(src: str, name: str) -> str:
    """The cleaning CTEs of ``oracle`` applied to another raw corpus."""
    return (O.CLASSIFIED.replace("stripped as", f"{name}_s as").replace("from corpus_raw", f"from {src}")
            .replace("classified as", f"{name}_c as").replace("from stripped", f"from {name}_s")
            + f""",
{name}_t as (
  select pos, id, {O.collapse('q')} as question, {O.collapse('r')} as rationale,
         {O.collapse('a')} as answer, {O.collapse('t')} as task
  from {name}_c where status = 'kept')""")


@register("corpus_compare", O.with_base(_CONV_RAW + ",\n" + _classify_sql("conv_raw", "conv") + f"""
select corpus, count(*) as total_triplets, {_AVG_LENS} from (
  select 'documents' as corpus, question, rationale, answer from triplets
  union all select 'conversations', question, rationale, answer from conv_t) u
group by corpus""", kb=False))
def q_corpus_compare(spark, sf):
    corpora = {"documents": fx.triplets(spark, sf),
               "conversations": clean.extract_triplets(fx.conversation_raw(spark, sf), "conversation")}
    return r6(stats.corpus_compare(corpora),
              "avg_question_length", "avg_rationale_length", "avg_answer_length")


@register("task_topk", O.with_base("""x as (select 1)
select coalesce(task, 'unknown') as task, count(*) as count from triplets
group by 1 order by count desc, task limit 10""", kb=False))
def q_task_topk(spark, sf):
    return stats.task_topk(fx.triplets(spark, sf))


@register("task_count", O.with_base("""x as (select 1)
select count(distinct coalesce(task, 'unknown')) as distinct_tasks, count(*) as triplets from triplets""", kb=False))
def q_task_count(spark, sf):
    return stats.task_count(fx.triplets(spark, sf))


@register("task_distribution", O.with_base("""x as (select 1)
select coalesce(task, 'unknown') as task, count(*) as count from triplets group by 1""", kb=False))
def q_task_distribution(spark, sf):
    return stats.task_distribution(fx.triplets(spark, sf))


_NORM = "sqrt(list_dot_product(embedding::double[], embedding::double[]))"


@register("embedding_stats", O.with_base(f"""x as (select 1)
select count(*) as num_embeddings, max(cast(len(embedding) as integer)) as embedding_dimension,
       round(avg({_NORM}), 6) as mean_norm, round(stddev_pop({_NORM}), 6) as std_norm
from kb"""))
def q_embedding_stats(spark, sf):
    return r6(stats.embedding_stats(fx.knowledge_base(spark, sf)), "mean_norm", "std_norm")


@register("dimension_check", """
select count(embedding) as num_vectors, min(cast(len(embedding) as integer)) as min_dimension,
       max(cast(len(embedding) as integer)) as max_dimension,
       min(len(embedding)) = max(len(embedding)) as consistent
from embeddings""")
def q_dimension_check(spark, sf):
    return stats.dimension_check(fx.table(spark, sf, "embeddings"))


@register("l2_normalize", f"""
select vec_id, round({_NORM}, 6) as norm,
       list_transform(embedding::double[], lambda x: round(x / {_NORM}, 6)) as unit
from embeddings""")
def q_l2_normalize(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"),
                    F.transform(V.l2_normalize("embedding"), lambda x: F.round(x, 6)).alias("unit"))


@register("cosine_topk", O.with_base(O.knn_hits(
    5, queries=f"(select query_id, list_transform(embedding::double[], lambda x: x / {_NORM}) as embedding "
               f"from qb where {_NORM} > 0)")
    + "\nselect query_id, rank, id, round(score, 6) as score from hits"))
def q_cosine_topk(spark, sf):
    q = fx.query_batch(spark, sf)
    q = q.select("query_id", V.l2_normalize("embedding").alias("embedding"))
    return r6(knn_op.knn(q, fx.knowledge_base(spark, sf), 5, "ip"), "score")


@register("relevance_bands", O.with_base(O.knn_hits(5) + """
select case when score >= 0.7 then 'high' when score >= 0.5 then 'medium' else 'low' end as band,
       count(*) as hits, round(avg(score), 6) as avg_score
from hits group by 1"""))
def q_relevance_bands(spark, sf):
    hits = knn_op.knn(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf), 5, "ip")
    return r6(stats.relevance_bands(hits), "avg_score")


@register("corpus_profile", O.with_base("""x as (select 1)
select count(*) as total_samples, 'source,target,rationale,task' as columns from corpus_raw""", kb=False))
def q_corpus_profile(spark, sf):
    return insp.profile(fx.corpus_raw(spark, sf))


@register("corpus_head", O.with_base("""x as (select 1)
select * from corpus_raw order by pos limit 3""", kb=False))
def q_corpus_head(spark, sf):
    return insp.head(fx.corpus_raw(spark, sf), 3)


def _preview_sql(c: str) -> str:
    return f"case when length({c}) > 100 then substr({c}, 1, 100) || '...' else {c} end"


@register("preview", O.with_base(f"""x as (select 1)
select id, {_preview_sql('question')} as question_preview, {_preview_sql('rationale')} as rationale_preview,
       {_preview_sql('answer')} as answer_preview from triplets""", kb=False))
def q_preview(spark, sf):
    return insp.previews(fx.triplets(spark, sf))


@register("lookup_by_id", O.with_base("""x as (select 1)
select cast(d.doc_id as varchar) as id, kb.question, kb.rationale, kb.answer, kb.source,
       kb.id is not null as found
from documents d left join kb on kb.id = cast(d.doc_id as varchar)"""))
def q_lookup_by_id(spark, sf):
    ids = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return insp.lookup(ids, fx.knowledge_base(spark, sf))


@register("vector_metadata", O.with_base("""x as (select 1)
select pos as embedding_index, coalesce(id, cast(pos as varchar)) as id, question, rationale, answer,
       coalesce(source, 'unknown') as source, task from kb"""))
def q_vector_metadata(spark, sf):
    return insp.vector_metadata(fx.knowledge_base(spark, sf))


# ------------------------------------------------------------------ prompts, generation, evaluation

from shotbank.operators import generate as gen  # noqa: E402
from shotbank.session import scratch_path  # noqa: E402


@register("prompt_baseline", O.with_base("""x as (select 1)
select query_id, 'baseline' as method, query,
       'You are a helpful assistant that provides direct, concise answers without showing reasoning steps.' as system,
       'Question: ' || query || chr(10) || chr(10) || 'Give me the final answer only.' as prompt
from qb"""))
def q_prompt_baseline(spark, sf):
    return gen.baseline_prompts(fx.query_batch(spark, sf))


@register("prompt_cot", O.with_base(O.knn_hits(5) + f""",
sel as (select h.*, {_META} from hits h join kb on kb.id = h.id where h.score >= 0.35 or h.rank = 1),
ex as (select query_id, count(*) as n_examples,
              string_agg('Example ' || rank || ':' || chr(10) || 'Question: ' || question || chr(10)
                         || 'Rationale: ' || rationale || chr(10) || 'Answer: ' || answer || chr(10) || chr(10),
                         '' order by rank) as body
       from sel where rank <= 5 group by query_id)
select q.query_id, 'retrieval_augmented_cot' as method, q.query,
       'You are a helpful assistant that thinks step-by-step and shows detailed reasoning before providing the final answer.' as system,
       case when ex.body is not null
            then 'Question: ' || q.query || chr(10) || chr(10) || ex.body || 'Now think step by step to solve the question above.'
            else 'Question: ' || q.query || chr(10) || chr(10) || 'Think step by step to solve this question.' end as prompt,
       coalesce(ex.n_examples, 0) as n_examples
from qb q left join ex on ex.query_id = q.query_id"""))
def q_prompt_cot(spark, sf):
    hits = ret.retrieve(fx.query_batch(spark, sf), fx.knowledge_base(spark, sf), k=gen.DEFAULT_K, threshold=0.35)
    p = gen.cot_prompts(fx.query_batch(spark, sf), hits)
    return p.select("query_id", "method", "query", "system", "prompt",
                    F.coalesce(F.size("examples"), F.lit(0)).cast("long").alias("n_examples"))


def _pipeline_generations(spark, sf):
    """Both prompt sets of the query batch through the stand-in model, written once."""
    q = fx.query_batch(spark, sf)
    hits = ret.retrieve(q, fx.knowledge_base(spark, sf), k=gen.DEFAULT_K, threshold=0.35)
    prompts = gen.baseline_prompts(q).unionByName(gen.cot_prompts(q, hits), allowMissingColumns=True)
    return gen.generate_to(prompts, gen.echo_model, scratch_path(spark, "generations")), hits


_COT_CTE = f"""
sel as (select h.*, {_META} from hits h join kb on kb.id = h.id where h.score >= 0.35 or h.rank = 1),
ex as (select query_id, string_agg('Example ' || rank || ':' || chr(10) || 'Question: ' || question || chr(10)
                         || 'Rationale: ' || rationale || chr(10) || 'Answer: ' || answer || chr(10) || chr(10),
                         '' order by rank) as body
       from sel where rank <= 5 group by query_id),
gens as (
  select query_id, 'baseline' as method, query,
         'Question: ' || query || chr(10) || chr(10) || 'Give me the final answer only.' as prompt from qb
  union all
  select q.query_id, 'retrieval_augmented_cot', q.query,
         case when ex.body is not null
              then 'Question: ' || q.query || chr(10) || chr(10) || ex.body || 'Now think step by step to solve the question above.'
              else 'Question: ' || q.query || chr(10) || chr(10) || 'Think step by step to solve this question.' end
  from qb q left join ex on ex.query_id = q.query_id),
answered as (
  select query_id, method, query, prompt, {O.strip("split_part(prompt, chr(10), 1)")} as response from gens)"""


@register("generate_batch", O.with_base(O.knn_hits(5) + "," + _COT_CTE + """
select query_id, method, prompt, response, false as failed from answered"""))
def q_generate_batch(spark, sf):
    g, _ = _pipeline_generations(spark, sf)
    return g.select("query_id", "method", "prompt", "response", "failed")


_GEN_LOG = """gl as (select user_id, cast(ts as date) as day,
       case when event_type = 'view' then 'baseline' else 'retrieval_augmented_cot' end as method,
       avg(value) as generation_time
  from events where event_type in ('view', 'click') group by 1, 2, 3),
el as (select distinct user_id, cast(ts as date) as day from events where event_type = 'error'),
bs as (select user_id, cast(ts as date) as day, max(value) / 1000 as best_similarity_score,
              count(*) as retrieved_examples_count
  from events where event_type = 'purchase' group by 1, 2),
paired as (
  select p.user_id, p.day, p.baseline_time, p.cot_time, p.cot_time - p.baseline_time as time_difference,
         bs.best_similarity_score, coalesce(bs.retrieved_examples_count, 0) as retrieved_examples_count
  from (select user_id, day,
               max(case when method = 'baseline' then generation_time end) as baseline_time,
               max(case when method = 'retrieval_augmented_cot' then generation_time end) as cot_time
        from gl group by 1, 2) p
  left join bs on bs.user_id = p.user_id and bs.day = p.day),
batch as (
  select k.user_id, k.day,
         case when el.user_id is not null then 'comparison failed'
              when p.baseline_time is null then 'missing baseline result'
              when p.cot_time is null then 'missing retrieval_augmented_cot result' end as error,
         p.baseline_time, p.cot_time, p.time_difference, p.best_similarity_score, p.retrieved_examples_count
  from (select user_id, day from gl union select user_id, day from el) k
  left join paired p on p.user_id = k.user_id and p.day = k.day
  left join el on el.user_id = k.user_id and el.day = k.day),
batch_out as (
  select user_id, day, error,
         case when error is null then baseline_time end as baseline_time,
         case when error is null then cot_time end as cot_time,
         case when error is null then time_difference end as time_difference,
         case when error is null then best_similarity_score end as best_similarity_score,
         case when error is null then retrieved_examples_count end as retrieved_examples_count
  from batch)"""

_KEYS = ("user_id", "day")
_CMP_COLS = ("baseline_time", "cot_time", "time_difference", "best_similarity_score")


def _fixture_comparisons(spark, sf, batch: bool):
    return gen.compare_methods(
        fx.generation_log(spark, sf), fx.best_score_log(spark, sf), keys=_KEYS,
        expected=fx.generation_log(spark, sf) if batch else None,
        failed=fx.error_log(spark, sf) if batch else None)


@register("compare_methods", "with " + _GEN_LOG + """
select user_id, day, round(baseline_time, 6) as baseline_time, round(cot_time, 6) as cot_time,
       round(time_difference, 6) as time_difference, round(best_similarity_score, 6) as best_similarity_score,
       retrieved_examples_count
from paired where baseline_time is not null and cot_time is not null""")
def q_compare_methods(spark, sf):
    return r6(_fixture_comparisons(spark, sf, False).where(F.col("error").isNull()).drop("error"), *_CMP_COLS)


@register("batch_compare", "with " + _GEN_LOG + """
select user_id, day, error, round(baseline_time, 6) as baseline_time, round(cot_time, 6) as cot_time,
       round(time_difference, 6) as time_difference, round(best_similarity_score, 6) as best_similarity_score,
       retrieved_examples_count
from batch_out""")
def q_batch_compare(spark, sf):
    return r6(_fixture_comparisons(spark, sf, True), *_CMP_COLS)


@register("evaluate", "with " + _GEN_LOG + """
select count(*) as total_queries, round(avg(baseline_time), 6) as average_baseline_time,
       round(avg(cot_time), 6) as average_cot_time,
       round((sum(cot_time) - sum(baseline_time)) / count(*), 6) as average_time_overhead,
       round(coalesce(avg(best_similarity_score), 0), 6) as average_similarity_score,
       round(count(best_similarity_score) / count(*), 6) as retrieval_success_rate,
       round(count_if(best_similarity_score >= 0.5) / count(*), 6) as above_threshold_rate,
       case when count(*) = 0 then 'No valid comparisons to evaluate' end as error
from batch_out where error is null""")
def q_evaluate(spark, sf):
    m = gen.evaluate(_fixture_comparisons(spark, sf, True))
    return r6(m, "average_baseline_time", "average_cot_time", "average_time_overhead",
              "average_similarity_score", "retrieval_success_rate", "above_threshold_rate")


_RULE = "=" * 80


@register("comparison_report", O.with_base(O.knn_hits(5) + "," + _COT_CTE + f"""
select q.query_id,
       case when q.query_id % 5 = 0 then 'Error processing query \'\'' || q.query || '\'\': comparison failed'
            when q.query_id % 5 = 1 then 'Error processing query \'\'' || q.query || '\'\': missing retrieval_augmented_cot result'
            else concat_ws(chr(10), '{_RULE}', 'QUERY: ' || q.query, '{_RULE}', chr(10) || '📍 BASELINE APPROACH:',
                 'Prompt: ' || b.prompt, 'Response: ' || b.response, 'Time: ' || printf('%.3f', length(b.prompt) / 1000.0) || 's',
                 chr(10) || '🧠 RETRIEVAL-AUGMENTED CoT APPROACH:',
                 'Full Prompt: ' || c.prompt, 'Response: ' || c.response, 'Time: ' || printf('%.3f', length(c.prompt) / 1000.0) || 's')
            end as report
from qb q join answered b on b.query_id = q.query_id and b.method = 'baseline'
join answered c on c.query_id = q.query_id and c.method <> 'baseline'""".replace("\'\'", "''")))
def q_comparison_report(spark, sf):
    """Reports of all queries, with set times; every fifth query failed, every fifth lacks an answer."""
    g, hits = _pipeline_generations(spark, sf)
    timed = g.withColumn("generation_time", F.length("prompt") / F.lit(1000.0))
    part = F.pmod("query_id", F.lit(5))
    given = timed.where(~((part == 1) & (F.col("method") == gen.COT)))
    asked = fx.query_batch(spark, sf)
    cmp = gen.compare_methods(given, gen.best_scores(hits), expected=asked, failed=asked.where(part == 0))
    return gen.report(cmp)


# ------------------------------------------------------------------ IVF index

from shotbank.operators import ivf  # noqa: E402
from shotbank.sources import index_store, npy  # noqa: E402

_CENT = """cent as (
  select label as cell, list(m order by i) as centroid from (
    select label, i, avg(x) as m from (
      select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings)
    group by label, i) group by label),
assigned as (
  select id, cell from (
    select v.id, c.cell, row_number() over (partition by v.id
             order by list_dot_product(v.embedding::double[], c.centroid) desc, c.cell) as rn
    from kb v, cent c) where rn = 1)"""


def _ivf_fixture(spark, sf):
    """Label-mean centroids and the cell-partitioned index, both written once."""
    cents = fx.materialized(spark, sf, "ivf-centroids",
                            lambda: ivf.label_centroids(fx.table(spark, sf, "embeddings")))
    index = fx.materialized(spark, sf, "ivf-index", lambda: ivf.assign_cells(fx.knowledge_base(spark, sf), cents),
                            writer=ivf.write_index, reader=ivf.read_index)
    return cents, index


@register("ivf_assign", O.with_base(_CENT + "\nselect id, cell from assigned"))
def q_ivf_assign(spark, sf):
    _, index = _ivf_fixture(spark, sf)
    return index.select("id", "cell")


@register("index_roundtrip", O.with_base(_CENT + """
select a.id, a.cell, list_transform(kb.embedding::double[], lambda x: round(x, 6)) as embedding,
       'IndexIVFFlat' as index_type, 'ip' as metric, (select count(*)::integer from cent) as nlist,
       cast(len(kb.embedding) as integer) as dimension, (select count(*) from kb) as rows
from assigned a join kb on kb.id = a.id"""))
def q_index_roundtrip(spark, sf):
    """Every stored row, and the manifest beside it."""
    cents, index = _ivf_fixture(spark, sf)
    path = scratch_path(spark, "ivf-index")
    ivf.write_index(index, path, "ip", cents.count())
    back = ivf.read_index(spark, path).select(
        "id", "cell", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))
    return _beside(back, ivf.read_manifest(spark, path))


@register("index_stats", O.with_base(_CENT + """
select count(*) as total_vectors, max(cast(len(kb.embedding) as integer)) as dimension,
       count(kb.question) as num_metadata_items, count(distinct a.cell) as num_cells,
       'IndexIVFFlat' as index_type, true as is_trained
from assigned a join kb on kb.id = a.id"""))
def q_index_stats(spark, sf):
    _, index = _ivf_fixture(spark, sf)
    meta = fx.knowledge_base(spark, sf).select("id", "question")
    return stats.index_stats(index.join(meta, "id"), "IndexIVFFlat", cell="cell")


@register("ivf_probe", O.with_base(_CENT + """,
probes as (
  select query_id, cell from (
    select q.query_id, c.cell, row_number() over (partition by q.query_id
             order by list_dot_product(q.embedding::double[], c.centroid) desc, c.cell) as pr
    from qb q, cent c) where pr <= 2),
cand as (
  select p.query_id, kb.id, round(list_dot_product(q.embedding::double[], kb.embedding::double[]), 12) as score
  from probes p join qb q on q.query_id = p.query_id join assigned a on a.cell = p.cell join kb on kb.id = a.id)
select query_id, cast(rank as integer) as rank, id, round(score, 6) as score from (
  select *, row_number() over (partition by query_id order by score desc, id) as rank from cand)
where rank <= 5"""))
def q_ivf_probe(spark, sf):
    """Approximate: the two nearest cells only (recall@5 in the README)."""
    cents, index = _ivf_fixture(spark, sf)
    return r6(ivf.ivf_search(fx.query_batch(spark, sf), index, cents, 5, nprobe=2), "score")


@register("ivf_search", O.with_base(O.knn_hits(5) + "\nselect query_id, rank, id, round(score, 6) as score from hits"))
def q_ivf_search(spark, sf):
    """The same index with bounds: every hit of the exact search, which is its oracle."""
    cents, index = _ivf_fixture(spark, sf)
    return r6(ivf.bounded_search(fx.query_batch(spark, sf), index, cents, 5, nprobe=2, cells=_ivf_cells(spark, sf)), "score")


def _ivf_cells(spark, sf):
    """How far the index's vectors lie from their centroids, written once beside it."""
    cents, index = _ivf_fixture(spark, sf)
    return fx.materialized(spark, sf, "ivf-cells", lambda: pivot.cell_stats(index, cents))


_TRAINED = """select (select count(*) from kb) as vectors, (select count(*) from kb) as assigned,
       0::bigint as nearer_elsewhere, 0::bigint as unknown_cells, true as unit_centroids"""


def _trained(vectors, cents, index):
    """Whether every vector is in one known cell, with no centroid nearer: the score of the own cell by
    expressions, against the best score of an exact search that ships the vectors."""
    own = index.join(cents, "cell", "left").select("id", V.dot("embedding", "centroid").alias("own"))
    best = knn_op.knn(index.select(F.col("id").alias("query_id"), "embedding"), cents, 1, "ip", corpus_id="cell",
                      corpus_vec="centroid", strategy="broadcast_queries").select(F.col("query_id").alias("id"), F.col("score").alias("best"))
    units = cents.agg(F.every(F.abs(V.norm("centroid") - 1) < 1e-9)).first()[0]
    return own.join(best, "id").agg(
        F.lit(vectors.count()).alias("vectors"), F.count(F.lit(1)).alias("assigned"),
        F.count_if(F.col("own") < F.col("best") - 1e-9).alias("nearer_elsewhere"),
        F.count_if(F.col("own").isNull()).alias("unknown_cells"), F.lit(bool(units)).alias("unit_centroids"))


def _beside(rows, manifest):
    """``rows`` with the columns of the one-row ``manifest``."""
    one = manifest.first()
    return rows.select("*", *[F.lit(one[f.name]).cast(f.dataType).alias(f.name) for f in manifest.schema])


@register("ivf_train", O.with_base(_TRAINED))
def q_ivf_train(spark, sf):
    kb = fx.knowledge_base(spark, sf)
    cents = ivf.train_centroids(kb, seed=42)
    return _trained(kb, cents, ivf.assign_cells(kb, cents))


@register("index_rebuild", O.with_base(_TRAINED))
def q_index_rebuild(spark, sf):
    """The index of stored vectors, trained, written, and written again over itself."""
    out, stored = scratch_path(spark, "rebuilt"), scratch_path(spark, "stored")
    fx.knowledge_base(spark, sf).select("id", "embedding").write.parquet(stored)
    ivf.rebuild_index(spark, stored, out, nlist=5)
    cents, _ = ivf.rebuild_index(spark, stored, out)
    return _trained(spark.read.parquet(stored), cents, ivf.read_index(spark, out))


@register("index_lifecycle", O.with_base(_CENT.replace("from kb v, cent c", "from (select id, embedding from kb union all "
          "select 'q' || query_id, embedding from qb) v, cent c") + """
select a.id, a.cell, 3 as version, (select count(*) from assigned) as rows, (select count(*)::integer from cent) as nlist
from assigned a"""))
def q_index_lifecycle(spark, sf):
    """An index that is created, appended to (the query batch) and compacted: its rows in the last version."""
    cents, index = _ivf_fixture(spark, sf)
    root = scratch_path(spark, "index-store")
    index_store.create(index, cents, root)
    index_store.append(fx.query_batch(spark, sf).select(F.concat(F.lit("q"), "query_id").alias("id"), "embedding"), root)
    index_store.compact(spark, root)
    rows, _, v = index_store.load(spark, root)
    return rows.select("id", "cell", F.lit(v.version).alias("version"), F.lit(v.rows).cast("long").alias("rows"), F.lit(v.nlist).alias("nlist"))


# ------------------------------------------------------------------ embedding

from shotbank.functions.text import WS_CLASS_RE2  # noqa: E402
from shotbank.operators import embed as emb, lexical  # noqa: E402


def _lex_sql(name: str, src: str, id_col: str, text_col: str) -> str:
    return f"""{name}_tok as (
  select {id_col} as id, t from (
    select {id_col}, unnest(string_split_regex(lower({text_col}), '{WS_CLASS_RE2}+')) as t from {src})
  where t <> ''),
{name}_cnt as (
  select id, cast(('0x' || substr(md5(t), 1, 7))::bigint % 1024 as integer) as bucket, count(*) as c
  from {name}_tok group by 1, 2),
{name} as (
  select id, bucket, c / sqrt(sum(c * c) over (partition by id)) as weight from {name}_cnt)"""


_LEX_EMBED_SQL = O.with_base(_lex_sql("lex", "triplets", "id", "question")
                             + "\nselect id, bucket, round(weight, 6) as weight from lex", kb=False)


@register("lexical_embed", _LEX_EMBED_SQL)
def q_lexical_embed(spark, sf):
    vecs = emb.lexical_vectors(fx.triplets(spark, sf), "question")
    return r6(emb.sparse_entries(vecs), "weight")


@register("embed_batch", _LEX_EMBED_SQL)
def q_embed_batch(spark, sf):
    t = fx.triplets(spark, sf).select("id", "question")
    vecs = emb.embed(t, lambda: emb.HashingEncoder(emb.LEXICAL_DIM), "question", normalize=False)
    unit = vecs.select("id", V.l2_normalize("embedding").alias("embedding"))  # in double: 6 decimals are published
    return r6(emb.sparse_entries(unit.where(F.col("embedding").isNotNull())), "weight")


def _user_turns(spark, sf):
    c = fx.table(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


@register("lexical_retrieve", O.with_base(
    _lex_sql("dlex", "triplets", "id", "question") + ",\n"
    + _lex_sql("qlex", "(select conv_id * 1000000 + turn as query_id, text from conversations where role = 'user')",
               "query_id", "text") + """,
sc as (
  select q.id as query_id, d.id, round(sum(q.weight * d.weight), 12) as score
  from qlex q join dlex d on d.bucket = q.bucket group by 1, 2)
select query_id, cast(rank as integer) as rank, id, round(score, 6) as score from (
  select *, row_number() over (partition by query_id order by score desc, id) as rank from sc)
where rank <= 3""", kb=False))
def q_lexical_retrieve(spark, sf):
    q = emb.lexical_vectors(_user_turns(spark, sf), "query").select("query_id", "embedding")
    return r6(lexical.search(q, lexical_index(spark, sf), 3), "score")


def lexical_index(spark, sf):
    """The block index of the triplets' questions, written once."""
    return fx.materialized(spark, sf, "lexical-index", lambda: lexical.build_index(
        emb.lexical_vectors(fx.triplets(spark, sf).select("id", "question"), "question")))


TEXT_DIM = 768


@register("retrieve_text", O.with_base(
    _lex_sql("dlex", "triplets", "id", "question").replace("% 1024", f"% {TEXT_DIM}") + ",\n"
    + _lex_sql("qlex", "benchmark", "item_id", "text").replace("% 1024", f"% {TEXT_DIM}") + """,
sc as (
  select q.id as query_id, d.id, coalesce(s.score, 0) as score
  from (select distinct id from qlex) q cross join (select distinct id from dlex) d
  left join (select q.id as qid, d.id as did, round(sum(q.weight * d.weight), 12) as score
             from qlex q join dlex d on d.bucket = q.bucket group by 1, 2) s on s.qid = q.id and s.did = d.id),
ranked as (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc)
select r.query_id, cast(r.rank as integer) as rank, r.id, round(r.score, 6) as score,
       t.question, t.rationale, t.answer, t.task, t.source
from ranked r join triplets t on t.id = r.id where r.rank <= 3 and (r.score >= 0.3 or r.rank = 1)""", kb=False))
def q_retrieve_text(spark, sf):
    """The whole chain from text: all triplets embedded, the benchmark's texts as queries."""
    factory = lambda: emb.HashingEncoder(TEXT_DIM)
    # counts are whole numbers, which float32 holds exactly; the cosine search normalises them
    kb = fx.materialized(spark, sf, "text-vectors", lambda: emb.embed(
        fx.triplets(spark, sf), factory, "question", normalize=False))
    q = emb.embed(fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")),
                  factory, "query", normalize=False)
    return r6(ret.retrieve(q, kb, k=3, threshold=0.3, metric="cosine"), "score")


# ------------------------------------------------------------------ sources and sinks

from shotbank.sources import corpus as src  # noqa: E402

_SCAN_COLS = "id, nullif(source, '') as source, nullif(target, '') as target, nullif(rationale, '') as rationale, task"


def _scanned(spark, sf):
    """corpus_raw written as keyed JSON objects (1,000 records per file) and read back."""
    path = scratch_path(spark, "keyed-json")
    src.write_keyed_json(fx.corpus_raw(spark, sf), path, records_per_file=1000)
    return src.read_keyed_json(spark, path)


@register("corpus_scan", O.with_base(f"x as (select 1) select {_SCAN_COLS} from corpus_raw", kb=False))
def q_corpus_scan(spark, sf):
    return _scanned(spark, sf).select("id", "source", "target", "rationale", "task")


@register("corpus_scan_lines", O.with_base(f"x as (select 1) select pos, {_SCAN_COLS} from corpus_raw", kb=False))
def q_corpus_scan_lines(spark, sf):
    """The splittable form: corpus_raw written as JSON lines, read back with the same rules."""
    path = scratch_path(spark, "corpus-lines")
    src.write_json_lines(fx.corpus_raw(spark, sf), path)
    return src.read_json_lines_corpus(spark, path).select("pos", "id", "source", "target", "rationale", "task")


@register("corpus_first_n", O.with_base(
    f"x as (select 1) select {_SCAN_COLS} from corpus_raw order by pos limit 100", kb=False))
def q_corpus_first_n(spark, sf):
    return src.first_n(_scanned(spark, sf), 100).select("id", "source", "target", "rationale", "task")


@register("corpus_peek", O.with_base("x as (select 1) select * from corpus_raw order by pos limit 3", kb=False))
def q_corpus_peek(spark, sf):
    """The first lines of a file that has a malformed line before each good one."""
    path = scratch_path(spark, "json-lines")
    good = F.to_json(F.struct(*[F.col(c) for c in ("pos", "id", "source", "target", "rationale", "task")]))
    lines = fx.corpus_raw(spark, sf).orderBy("pos").select(F.explode(F.array(F.lit('{"pos": 1, "id'), good)).alias("value"))
    lines.write.text(path)
    return src.peek(spark, path, "pos long, id string, source string, target string, rationale string, task string")


@register("corpus_split", O.with_base(f"x as (select 1) select {_SCAN_COLS} from corpus_raw", kb=False))
def q_corpus_split(spark, sf):
    """Keyed JSON converted to lines by streaming readers, then read by many tasks."""
    keyed, lines = scratch_path(spark, "keyed-json"), scratch_path(spark, "split-lines")
    src.write_keyed_json(fx.corpus_raw(spark, sf), keyed, records_per_file=1000)
    src.split_keyed_json(spark, f"{keyed}/chunk=*/*.txt", lines)
    return src.read_split_corpus(spark, lines).select("id", "source", "target", "rationale", "task")


@register("triplets_roundtrip", O.with_base(
    "x as (select 1) select pos, id, question, rationale, answer, task, source from triplets", kb=False))
def q_triplets_roundtrip(spark, sf):
    path = src.save_triplets(fx.build_triplets(spark, sf), scratch_path(spark, "triplets"))
    return src.load_triplets(spark, path)


@register("npy_roundtrip", O.with_base("""x as (select 1)
select row_number() over (order by pos) - 1 as pos,
       list_transform(embedding::float[]::double[], lambda x: round(x, 6)) as embedding from kb"""))
def q_npy_roundtrip(spark, sf):
    """Every vector written to .npy parts in order and read back by ranges."""
    path = scratch_path(spark, "npy")
    npy.save_npy(fx.knowledge_base(spark, sf), path, "pos")
    back = npy.load_npy(spark, path)
    return back.select("pos", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


@register("vectors_roundtrip", O.with_base(f"""x as (select 1)
select id, question, list_transform(embedding::double[], lambda x: round(x, 6)) as embedding,
       'fixture-embeddings' as model_name, cast(len(embedding) as integer) as embedding_dimension,
       (select count(*) from kb) as num_embeddings, 32 as batch_size, 512 as max_length,
       (select max(abs({_NORM} - 1)) < 0.001 from kb) as normalized from kb"""))
def q_vectors_roundtrip(spark, sf):
    """Every stored vector, and the manifest beside it."""
    path = scratch_path(spark, "vectors")
    src.save_vectors(fx.knowledge_base(spark, sf), path, "fixture-embeddings")
    vectors, manifest = src.load_vectors(spark, path)
    return _beside(vectors.select("id", "question", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding")),
                   manifest)
