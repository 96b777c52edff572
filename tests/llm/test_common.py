import pytest
from pyspark.sql import functions as F
from shotbank.llm.common import _BATCH_CONF, BATCH_BYTES, keep_rows, map_rows


@pytest.fixture
def unset(spark):
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.unset(_BATCH_CONF)
    yield
    spark.conf.unset(_BATCH_CONF) if before is None else spark.conf.set(_BATCH_CONF, before)


def texts(spark):
    return spark.range(0, 1500, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))


def batch_bytes(spark):
    """(bytes, rows) of the batches that a worker is sent."""
    out = map_rows(texts(spark), "b long, n long", lambda cols: {"b": [cols["text"].nbytes], "n": [len(cols["text"])]})
    return [(r["b"], r["n"]) for r in out.collect()]


def test_a_worker_is_sent_few_texts_at_a_time(spark, unset):
    got = batch_bytes(spark)
    assert max(b for b, _ in got) <= BATCH_BYTES + 20_000 and sum(n for _, n in got) == 1500
    spark.conf.unset(_BATCH_CONF)
    kept = keep_rows(texts(spark), ["text"], lambda cols: [len(cols["text"]) * 10_000 <= BATCH_BYTES + 20_000] * len(cols["text"]))
    assert kept.count() == 1500


def test_a_bound_of_the_session_stays(spark, unset):
    spark.conf.set(_BATCH_CONF, str(64 << 20))
    assert [n for _, n in batch_bytes(spark)] == [1500] and spark.conf.get(_BATCH_CONF) == str(64 << 20)
