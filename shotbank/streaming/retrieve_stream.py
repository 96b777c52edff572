"""Answer queries as they arrive: Structured Streaming over a folder of query files.

The reference answers one query per process run; here new query files form
micro-batches, each micro-batch is one batch retrieval against the (static,
written) knowledge base, and the hits are appended to a Parquet sink.
``foreachBatch`` + the checkpoint make the run restartable: a batch is written
to ``<sink>/batch_id=<n>`` with overwrite, so a retried batch replaces its own
output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotbank.operators import retrieve as ret


def start(spark: SparkSession, query_dir: str, query_schema, vectors: DataFrame, sink: str,
          checkpoint: str, k: int | None = None, threshold: float | None = ret.DEFAULT_THRESHOLD,
          files_per_batch: int = 100, available_now: bool = False, **knn_options):
    """Start the stream; returns the StreamingQuery."""
    stream = (spark.readStream.schema(query_schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(query_dir))

    def answer_batch(batch: DataFrame, batch_id: int) -> None:
        hits = ret.retrieve(batch, vectors, k=k, threshold=threshold, **knn_options)
        (hits.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(answer_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
