import corpus_pipeline
import sentencepiece
from shotbank.llm import mil_quality, sp_scan, surrogates
from shotbank.llm.common import table

from .test_chosen_path import brute as groups
from .test_wu_manber import brute as hits


def test_stages_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    bench = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    before = docs.collect()
    library = sentencepiece.SentencePieceProcessor(model_file=sp_scan.MODEL)
    for (name, stage), number in zip(corpus_pipeline.STAGES, (2, 3, 6, 4, 7)):
        out = stage(spark, docs, sf)
        if number != 7:
            assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        rows = [(r["doc_id"], r["text"]) for r in before]
        after = out.collect()
        if number == 2:
            scores = mil_quality.score_corpus(docs, table(spark, sf, "labels")).collect()
            want = {r["doc_id"] for r in scores if r["predicted"]}
        elif number == 3:
            want = {d for d, _, _, first in groups(rows) if first}
        elif number == 6:
            want = {r[0] for r in hits(rows, bench) if not r[5]}
        else:
            want = {r[0] for r in rows}
        assert sorted(r["doc_id"] for r in after) == sorted(want), name
        if number == 4:
            old = dict(rows)
            for r in after:
                assert [k for _, _, k in surrogates.find(old[r["doc_id"]])] == [] or r["text"] != old[r["doc_id"]]
        if number == 7:
            for r in after:
                text = dict(rows)[r["doc_id"]]
                assert list(r["ids"]) == library.encode(text) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
        docs, before = out, after
    assert corpus_pipeline.run(spark, sf).count() == len(before)


def test_nothing_and_awkward_rows(spark, sf, awkward, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).count() == 0, name
        out = stage(spark, awkward, sf)
        assert out.count() <= awkward.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == awkward.columns
