"""Registered queries of the operators in this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotbank.llm import backoff_lm, chosen_path, cyk_repair, mil_quality, noisy_toxicity, radix_repeats, sp_scan, subspace_join, surrogates, token_alignment, url_markov, warc_revisit, wu_manber
from shotbank.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE["op1_subspace_join"] = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0),
 links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
           and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
 reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
 comp as (select a, min(b) as m from reach group by a),
 n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) as kept
from embeddings left join n on n.a = vec_id left join comp on comp.a = vec_id
"""


@_query
def op2_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.score_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents")).drop("h1", "h2")


@_query
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents"))


@_query
def op5_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_corpus(table(spark, sf_dir, "documents"))


@_query
def op6_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.contamination_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

ORACLE["op6_wu_manber"] = f"""
with d as (select doc_id, {WORDS} as w from documents),
 b as (select cast(item_id as varchar) as item, {WORDS} as w from benchmark),
 pats as (select distinct item, least(13, len(w)) as m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as pat
          from b, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) as t(i)),
 lens as (select distinct m from pats),
 wins as (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as pat
          from d, lens, unnest(range(1, len(w) - m + 2)) as t(i)),
 found as (select wins.doc_id, wins.i, wins.m, pats.item from wins join pats using (m, pat)),
 hit as (select doc_id, count(distinct k) as n_hit from (
           select doc_id, unnest(range(i, i + m)) as k from (select distinct doc_id, i, m from found)) group by doc_id),
 its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
         from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""


@_query
def op7_max_plus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_scan.digest(sp_scan.encode(table(spark, sf_dir, "documents")))


@_query
def op8_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge(table(spark, sf_dir, "pages"))


@_query
def op9_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_repeats.dedup_digest(table(spark, sf_dir, "documents"))


@_query
def op10_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32: each five hexadecimal digits of the SHA-1 are four digits of it
ORACLE["op10_warc_revisit"] = """
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
 top as (select h, max(page_id) as refers_to, count(*) as n from p group by h),
 digits as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // (1 << (15 - 5 * k))) % 32 + 1, 1), '' order by g, k) as digest
   from (select h, g, (16 ** 4 * d[1] + 16 ** 3 * d[2] + 16 ** 2 * d[3] + 16 * d[4] + d[5])::bigint as v
     from (select h, g, [instr('0123456789abcdef', substr(h, 5 * g + i, 1)) - 1 for i in range(1, 6)] as d from top, range(8) as t(g))),
     range(4) as s(k) group by h)
select page_id, strlen(payload) as payload_bytes, digest as payload_digest,
       case when page_id is not distinct from refers_to then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from refers_to then refers_to end as refers_to
from p join top using (h) join digits using (h)
"""


@_query
def op11_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy_toxicity.score_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op12_identity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


@_query
def op13_cyk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyk_repair.repair(cyk_repair.damage(table(spark, sf_dir, "conversations")))


# the rows from the last to the first: the cheapest rest of a repair from each of the four states (nothing yet, after
# s, after u, after a); n insertions, then an edit; a rest that starts with another never costs the same
def _repair_sql() -> str:
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    role = {"u": "'user'", "a": "'assistant'"}
    # states reached by insertions alone, with what they cost, their audit and their lines
    reach = {p: [(p, 0, "", "''")] for p in range(4)}
    for p in range(4):
        q, n, text = p, 0, []
        for _ in range(2):
            moves = [(r, t) for (s, r), t in step.items() if s == q and r != "s"]
            r, q = moves[0]
            n, text = n + 1, [*text, f"chr(10) || {role[r]} || ':'"]
            reach[p].append((q, n, "I" * n, " || ".join(text)))

    def option(cost: str, audit: str, text: str) -> str:
        return "{" + f"'c': {cost}, 'a': {audit}, 't': {text}" + "}"

    def best(p: int) -> str:
        found = []
        for q, n, ins, text in reach[p]:
            found.append(option(f"{3 * n} + 4 + s{q}.c", f"'{ins}D' || s{q}.a", f"{text} || s{q}.t"))
            for (s, r), t in step.items():
                if s == q:
                    keep = option(f"{3 * n} + more + s{t}.c", f"'{ins}K' || s{t}.a", f"{text} || chr(10) || role || ':' || text || s{t}.t")
                    found.append(f"case when not gone and ini = '{r}' then {keep} end")
                    if r != "s":
                        new = option(f"{3 * n + 3} + more + s{t}.c", f"'{ins}R' || s{t}.a",
                                     f"{text} || chr(10) || {role[r]} || ':' || text || s{t}.t")
                        found.append(f"case when not gone then {new} end")
        return f"least({', '.join(found)})"

    def last(p: int) -> str:
        if p in (0, 3):
            return option("0::bigint", "''", "''")
        q, n, ins, text = next(x for x in reach[p] if x[0] == 3)
        return option(f"{3 * n}::bigint", f"'{ins}'", text)

    some = "coalesce({}::varchar, ' ')".format
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with recursive tab as (select list_transform(range(256), lambda n: list_reduce([n] || range(8),
     lambda c, b: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as tab),
 raw as (select conv_id, turn, {some('role')} as role, {some('text')} as text,
   xor(list_reduce([4294967295::bigint] || list_transform(string_split({some('conv_id')} || ':' || {some('turn')}, ''), lambda x: ascii(x)::bigint),
     lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 20 as d from conversations, tab),
 rows as (select conv_id, turn, case when d = 4 then 'user' else role end as role,
   case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
   from raw, range(2) as r(copy) where d <> 0 and (copy = 0 or d = 3)),
 numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
   count(*) over (partition by conv_id) as n, left(role, 1) as ini,
   lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text) as before,
   rtrim(text, {space}) as shown from rows),
 first as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again from numbered),
 judged as (select *, shown = '' as blank, again and shown <> '' as dup,
   shown <> '' and not again and right(shown, 1) not in ('.', '!', '?') as cut from first),
 facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
   count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (cut) as truncated,
   count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal from judged group by conv_id),
 steps as (select conv_id, n as left_rows, {', '.join(f'{last(p)} as s{p}' for p in range(4))}
     from (select distinct conv_id, n from numbered)
   union all
   select conv_id, i - 1, {', '.join(f'{best(p)} as s{p}' for p in range(4))}
   from (select st.*, j.i, j.role, j.text, j.ini, j.blank or j.dup as gone, case when j.cut then 3 else 0 end as more
         from steps st join judged j on j.conv_id is not distinct from st.conv_id and j.i = st.left_rows)),
 roots as (select conv_id, s0 as r from steps where left_rows = 0)
select distinct o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(r.c, 0)::bigint as cost, coalesce(r.a, '') as audit,
  sha256(coalesce(r.t[2:], '')) as repaired_sha256
from conversations o left join facts on o.conv_id is not distinct from facts.conv_id
 left join roots on o.conv_id is not distinct from roots.conv_id
"""


ORACLE["op13_cyk_repair"] = _repair_sql()
