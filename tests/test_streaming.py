"""Streaming micro-batches give the same hits as one batch retrieval."""

import tempfile

from shotbank.operators import retrieve as ret
from shotbank.sources import fixtures as fx
from shotbank.streaming import retrieve_stream
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    q = fx.query_batch(spark, SF_SMALL)
    q.repartition(4).write.parquet(f"{d}/queries")
    kb = fx.knowledge_base(spark, SF_SMALL)
    query = retrieve_stream.start(spark, f"{d}/queries", q.schema, kb, f"{d}/hits",
                                  f"{d}/ckpt", k=3, threshold=0.35, files_per_batch=1, available_now=True)
    query.awaitTermination(300)
    got = spark.read.parquet(f"{d}/hits").select("query_id", "rank", "id")
    want = ret.retrieve(q, kb, k=3, threshold=0.35).select("query_id", "rank", "id")
    assert sorted(got.collect()) == sorted(want.collect())
    assert spark.read.parquet(f"{d}/hits").select("batch_id").distinct().count() >= 2


def test_restart_processes_only_new_files(spark):
    d = tempfile.mkdtemp(prefix="stream2-", dir="/tmp")
    q = fx.query_batch(spark, SF_SMALL)
    kb = fx.knowledge_base(spark, SF_SMALL)
    first, second = q.where("query_id % 2 = 0"), q.where("query_id % 2 = 1")
    first.write.parquet(f"{d}/queries/a")
    run = lambda: retrieve_stream.start(spark, f"{d}/queries/*", q.schema, kb, f"{d}/hits", f"{d}/ckpt",
                                        k=2, threshold=0, available_now=True)
    run().awaitTermination(300)
    n_first = spark.read.parquet(f"{d}/hits").count()
    second.write.parquet(f"{d}/queries/b")
    run().awaitTermination(300)  # same checkpoint: only the new files
    got = spark.read.parquet(f"{d}/hits").select("query_id", "rank", "id")
    want = ret.retrieve(q, kb, k=2, threshold=0).select("query_id", "rank", "id")
    assert n_first == first.count() * 2
    assert got.count() == want.count() and sorted(got.collect()) == sorted(want.collect())
