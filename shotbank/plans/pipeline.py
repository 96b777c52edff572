"""End-to-end jobs: the three phases of the reference as Spark jobs over whole tables.

* ``build``   - raw corpus -> clean triplets -> vectors (pluggable encoder, or
  given embeddings) -> optional IVF cells; every stage is written once under
  ``out`` (Parquet), so later phases read tables instead of re-running lineage.
* ``answer``  - a table of queries -> retrieval (exact or IVF) with threshold
  and fallback -> rendered examples.
* ``compare`` - baseline and example-augmented prompts -> one generation run
  (written) -> paired comparison -> metrics and reports.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotbank.operators import clean, embed as emb, generate as gen, ivf, retrieve as ret, stats
from shotbank.sources import corpus as src


@dataclass
class KnowledgeBase:
    triplets: str
    vectors: str
    centroids: str | None = None
    index: str | None = None

    def load(self, spark: SparkSession) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        vectors = spark.read.parquet(self.vectors)
        cents = spark.read.parquet(self.centroids) if self.centroids else None
        index = ivf.read_index(spark, self.index) if self.index else None
        return vectors, cents, index


def build(spark: SparkSession, raw: DataFrame, out: str, *, encoder_factory=None,
          embeddings: DataFrame | None = None, provenance: str = clean.DEFAULT_PROVENANCE,
          nlist: int | None = None, seed: int = 42) -> KnowledgeBase:
    """Phase 1. Either ``encoder_factory`` (embed the questions) or ``embeddings``
    (pos, embedding) joined on position must be given. ``nlist`` > 0 adds an IVF
    index trained with k-means; ``nlist = 0`` skips it."""
    triplets_path = src.save_triplets(clean.extract_triplets(raw, provenance), f"{out}/triplets")
    triplets = src.load_triplets(spark, triplets_path)
    if embeddings is not None:
        vectors = triplets.join(embeddings.select("pos", "embedding"), "pos")
    elif encoder_factory is not None:
        vectors = emb.embed(triplets, encoder_factory, "question").where(F.col("embedding").isNotNull())
    else:
        raise ValueError("give an encoder_factory or an embeddings table")
    src.save_vectors(vectors, f"{out}/kb", model_name=getattr(encoder_factory, "__name__", "given"))
    kb = KnowledgeBase(triplets=triplets_path, vectors=f"{out}/kb/vectors")
    stats.assert_dimension(spark.read.parquet(kb.vectors))  # the data's dimension; mixed is an error
    if nlist != 0:
        ivf.rebuild_index(spark, kb.vectors, f"{out}/ivf", nlist=nlist, seed=seed)
        kb.centroids, kb.index = f"{out}/ivf/centroids", f"{out}/ivf"
    return kb


def with_vectors(queries: DataFrame, encoder_factory=None) -> DataFrame:
    """``queries`` with an ``embedding``: as given, or of the query text by the encoder. A text that has no
    vector is asked all the same, and finds nothing."""
    if "embedding" in queries.columns:
        return queries
    if encoder_factory is None:
        raise ValueError("queries need an embedding column, or give an encoder_factory for their text")
    return emb.embed(queries, encoder_factory, "query")


def _search(kb_index, cents, nprobe: int | None):
    """The index search for ``retrieve``, or None for the exact one."""
    if not nprobe or kb_index is None:
        return None
    return lambda queries, k, info: ivf.ivf_search(queries, kb_index, cents, k, nprobe=nprobe, info=info)


def answer(spark: SparkSession, queries: DataFrame, kb: KnowledgeBase, k: int | None = None,
           threshold: float | None = ret.DEFAULT_THRESHOLD, format_type: str | None = None,
           nprobe: int | None = None, encoder_factory=None) -> DataFrame:
    """Phase 2: hits with metadata for every query, or the rendered text when
    ``format_type`` is given. ``nprobe`` searches the IVF index instead of all vectors.

    ``queries`` hold (query_id, embedding), or (query_id, query) with an ``encoder_factory``."""
    vectors, cents, index = kb.load(spark)
    queries, search = with_vectors(queries, encoder_factory), _search(index, cents, nprobe)
    if format_type:
        return ret.retrieve_and_format(queries, vectors, k=k, format_type=format_type, threshold=threshold, search=search)
    return ret.retrieve(queries, vectors, k=k, threshold=threshold, search=search)


def compare(spark: SparkSession, queries: DataFrame, kb: KnowledgeBase, model, out: str,
            k: int = gen.DEFAULT_K, threshold: float | None = ret.DEFAULT_THRESHOLD,
            parallelism: int | None = None, nprobe: int | None = None,
            encoder_factory=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phase 3: (comparisons, metrics, reports). Generation runs once and is written; its rows and the
    comparisons carry the examples with their scores. Queries as for ``answer``."""
    vectors, cents, index = kb.load(spark)
    hits = ret.retrieve(with_vectors(queries, encoder_factory), vectors, k=k, threshold=threshold,
                        search=_search(index, cents, nprobe))
    hits.write.mode("overwrite").parquet(f"{out}/hits")
    hits = spark.read.parquet(f"{out}/hits")
    prompts = gen.baseline_prompts(queries).unionByName(gen.cot_prompts(queries, hits), allowMissingColumns=True)
    generations = gen.generate_to(prompts, model, f"{out}/generations", parallelism)
    comparisons = gen.compare_methods(generations, gen.best_scores(hits), expected=queries)
    return comparisons, gen.evaluate(comparisons), gen.report(comparisons)
