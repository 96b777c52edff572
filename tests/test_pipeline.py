"""The three phases end to end on the smallest fixture."""

import tempfile

from shotbank.operators import embed as emb, generate as gen
from shotbank.plans import pipeline
from shotbank.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_build_answer_compare(spark):
    out = tempfile.mkdtemp(prefix="pipe-", dir="/tmp")
    raw = fx.corpus_raw(spark, SF_SMALL)
    kb = pipeline.build(spark, raw, out, encoder_factory=lambda: emb.HashingEncoder(256), nlist=4)
    vectors, cents, index = kb.load(spark)
    assert vectors.count() == 174 and cents.count() == 4 and index.count() == 174
    queries = emb.embed(fx.table(spark, SF_SMALL, "benchmark").selectExpr("item_id as query_id", "text as query"),
                        lambda: emb.HashingEncoder(256), "query")
    hits = pipeline.answer(spark, queries, kb, k=3, threshold=0.2)
    assert hits.groupBy("query_id").count().where("count > 3").count() == 0
    full = pipeline.answer(spark, queries, kb, k=3, threshold=0.0, nprobe=4).select("query_id", "rank", "id")
    exact = pipeline.answer(spark, queries, kb, k=3, threshold=0.0).select("query_id", "rank", "id")
    assert sorted(full.collect()) == sorted(exact.collect())
    texts = pipeline.answer(spark, queries, kb, format_type="prompt")
    assert texts.count() == queries.count()
    # the index with all cells probed renders the same texts, for every query
    assert sorted(pipeline.answer(spark, queries, kb, format_type="prompt", nprobe=4).collect()) == sorted(texts.collect())
    # queries as text
    asked = queries.drop("embedding")
    from_text = pipeline.answer(spark, asked, kb, k=3, threshold=0.2, encoder_factory=lambda: emb.HashingEncoder(256))
    assert sorted(from_text.collect()) == sorted(hits.collect())
    cmp, metrics, reports = pipeline.compare(spark, queries, kb, gen.echo_model, out + "/run")
    m = metrics.first()
    assert m.total_queries == queries.count() and m.retrieval_success_rate == 1.0
    assert reports.count() == queries.count()
    first = cmp.where("cot_examples is not null").first()
    assert first.cot_examples[0].score == first.best_similarity_score and first.cot_examples[0].question
    by_index, _, _ = pipeline.compare(spark, asked, kb, gen.echo_model, out + "/run2", nprobe=4,
                                      encoder_factory=lambda: emb.HashingEncoder(256))
    assert sorted(by_index.select("query_id", "cot_prompt").collect()) == sorted(cmp.select("query_id", "cot_prompt").collect())
