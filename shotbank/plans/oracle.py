"""DuckDB SQL that computes the same results as the registered Spark queries.

Used only by the correctness check (driver views: documents, embeddings,
events, conversations, benchmark, ...). The derived views of
``shotbank.sources.fixtures`` are spelled here as CTEs.
"""

from __future__ import annotations

from shotbank.functions.text import WS_CLASS_RE2 as WS

def strip(x: str) -> str:
    return "regexp_replace(" + x + ", '^" + WS + "+|" + WS + "+$', '', 'g')"


def collapse(x: str) -> str:
    """Strip then collapse runs (same as the Spark side)."""
    return "regexp_replace(" + strip(x) + ", '" + WS + "+', ' ', 'g')"


CORPUS_RAW = """corpus_raw as (
  select doc_id as pos, cast(doc_id as varchar) as id,
         split_part(text, chr(10), 1) as source,
         split_part(text, chr(10), -1) as target,
         case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else '' end as rationale,
         source as task
  from documents)"""

CLASSIFIED = f"""stripped as (
  select pos, id,
         case when source is not null and source <> '' then {strip('source')} end as q,
         case when rationale is not null and rationale <> '' then {strip('rationale')} end as r,
         case when target is not null and target <> '' then {strip('target')} end as a,
         {strip("coalesce(task, 'None')")} as t
  from corpus_raw),
classified as (
  select *,
         case when coalesce(q, '') = '' or coalesce(r, '') = '' or coalesce(a, '') = '' then 'missing'
              when length(q) < 3 or length(r) < 10 or length(a) < 1 then 'too_short'
              else 'kept' end as status
  from stripped)"""

TRIPLETS = f"""triplets as (
  select pos, id, {collapse('q')} as question, {collapse('r')} as rationale,
         {collapse('a')} as answer, {collapse('t')} as task, 'fixture' as source
  from classified where status = 'kept')"""

KB = """kb as (
  select t.*, e.embedding from triplets t join embeddings e on t.pos = e.vec_id)"""

QUERIES = """qb as (
  select c.pos as query_id, split_part(d.text, chr(10), 1) as query, e.embedding
  from classified c join documents d on d.doc_id = c.pos join embeddings e on e.vec_id = c.pos
  where c.status <> 'kept')"""

BASE = ",\n".join([CORPUS_RAW, CLASSIFIED, TRIPLETS])
BASE_KB = ",\n".join([BASE, KB, QUERIES])


def with_base(sql: str, kb: bool = True) -> str:
    return "with " + (BASE_KB if kb else BASE) + ",\n" + sql


def knn_hits(k: int, metric: str = "ip", queries: str = "qb", corpus: str = "kb",
             qid: str = "query_id", cid: str = "id", qvec: str = "embedding",
             cvec: str = "embedding", name: str = "hits") -> str:
    """CTE ``name``: top-k per query by brute force (the oracle may enumerate pairs)."""
    if metric == "ip":
        score = f"list_dot_product(q.{qvec}::double[], c.{cvec}::double[])"
        order = "score desc"
    elif metric == "cosine":
        score = f"list_cosine_similarity(q.{qvec}::double[], c.{cvec}::double[])"
        order = "score desc"
    elif metric == "l2":
        qv, cv = f"(q.{qvec}::double[])", f"(c.{cvec}::double[])"
        score = (f"list_sum(list_transform(range(1, len({qv}) + 1), "
                 f"lambda i: ({qv}[i] - {cv}[i]) * ({qv}[i] - {cv}[i])))")
        order = "score asc"
    else:
        raise ValueError(metric)
    return f"""{name}_all as (
  select q.{qid} as query_id, c.{cid} as id, round({score}, 12) as score
  from {queries} q, {corpus} c
  where q.{qvec} is not null and c.{cvec} is not null),
{name} as (
  select query_id, cast(rank as integer) as rank, id, score from (
    select *, row_number() over (partition by query_id order by {order}, id) as rank
    from {name}_all where score is not null and not isnan(score)) where rank <= {k})"""
