"""URL filter: rules where they fit, a character language-model ratio elsewhere.

Two smoothed variable-order Markov models over characters are trained, one on the urls that the
rules accept and one on those they reject. A url is scored by the difference of the two models' mean
log-likelihood per character. The cut is calibrated on the same urls by models that were not trained on them, fold by
fold.

Every distinct url that a rule decides is counted and calibrated on, at every size. The counts are one table by context
and fold, made in one shuffle; urls are scored in chunks, to each of which come the counts of its contexts. A fold's
models are the counts of the others. Contexts that no model uses (seen less than ``SEEN`` times) are left out.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shotbank.llm.common import _arrow_schema, map_rows, written

#: Fixed values of the contract: (verdict, host, path prefix).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Longest context in bytes (seven and the byte itself fill a code), and how often a context must have been seen.
ORDER, SEEN = 7, 3
#: Folds of the calibration; scores that agree in their first 1 / ``CUTS`` have no cut between them.
FOLDS = 10
CUTS = 1 << 14
#: Bytes of urls in a chunk, at least.
CHUNK = 1 << 19


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict): the longest rule that fits, or null for both."""
    url = F.col("url").cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
                      host.alias("host"), path.alias("path"))
    verdict, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is looked at first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        verdict, rule = F.when(fits, v).otherwise(verdict), F.when(fits, h + p).otherwise(rule)
    return df.select("*", rule.alias("rule"), verdict.alias("verdict"))


class Markov:
    """Interpolated character model: each order is smoothed by the next shorter one
    (Witten-Bell), the shortest by a uniform distribution over 256 byte values."""

    def __init__(self, texts: list[bytes], order: int = ORDER, seen: int = SEEN):
        self.order, self.seen = order, seen
        self.tables = [self._table(*np.unique(g, return_counts=True)) for g in self._codes(texts, order)[0]]

    @classmethod
    def of_counts(cls, n: np.ndarray, code: np.ndarray, count: np.ndarray, order: int = ORDER, seen: int = SEEN) -> Markov:
        """From counts of codes (see ``_codes``) of ``n`` bytes before; a code's counts are added up."""
        out = cls([], order, seen)
        for m in range(order + 1):
            here = (n == m) & (count > 0)
            keys, at = np.unique(code[here], return_inverse=True)
            out.tables[m] = cls._table(keys, np.bincount(at, count[here], len(keys)))
        return out

    @staticmethod
    def _table(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        ctx, first = np.unique(keys >> np.uint64(8), return_index=True)
        total = np.add.reduceat(counts, first) if len(keys) else np.zeros(0)
        kinds = np.diff(np.append(first, len(keys)))
        return keys, counts.astype(float), ctx, total.astype(float), kinds.astype(float)

    @staticmethod
    def _codes(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each n, the code of (n bytes before, byte) at every place of all texts, and where each text begins;
        a start mark of zeros, an end mark."""
        b = np.frombuffer(b"".join(bytes(order) + t + b"\n" for t in texts), np.uint8).astype(np.uint64)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + order * np.repeat(np.arange(1, len(texts) + 1), size)
        code = b[at]
        out = [code]
        for n in range(1, order + 1):
            code = code | (b[at - n] << np.uint64(8 * n))
            out.append(code)
        return out, first

    def logprob(self, t: bytes) -> np.ndarray:
        """Of each byte of a text and its end."""
        return self.logprobs([t])[0]

    def logprobs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte and the end of all texts, and where each text begins."""
        codes, first = self._codes(texts, self.order)
        p = np.full(len(codes[0]), 1 / 256)
        for c, (keys, counts, ctx, total, kinds) in zip(codes, self.tables):
            if not len(keys):
                continue
            i = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
            hit = np.where(keys[i] == c, counts[i], 0.0)
            h = c >> np.uint64(8)
            j = np.minimum(np.searchsorted(ctx, h), len(ctx) - 1)
            known = (ctx[j] == h) & (total[j] >= self.seen)
            n, k = np.where(known, total[j], 0.0), np.where(known, kinds[j], 1.0)
            p = np.where(known, (hit + k * p) / (n + k), p)
        return np.log(p), first


def ratios(accept: Markov, reject: Markov, urls: list) -> np.ndarray:
    """Mean log-likelihood per character under ``accept`` less that under ``reject``; null counts as empty."""
    texts = [(u or "").encode("utf-8", "replace") for u in urls]
    out = np.zeros(len(texts))
    for part in _chunks([len(t) for t in texts]):
        a, first = accept.logprobs(texts[part])
        b, _ = reject.logprobs(texts[part])
        size = np.diff(np.append(first, len(a)))
        out[part] = np.add.reduceat(a - b, first) / size
    return out


def _chunks(sizes: list[int], limit: int = 1 << 18):
    at, held = 0, 0
    for i, n in enumerate(sizes):
        held += n + 1
        if held >= limit or i == len(sizes) - 1:
            yield slice(at, i + 1)
            at, held = i + 1, 0


def ratio(accept: Markov, reject: Markov, url: str | None) -> float:
    return float(ratios(accept, reject, [url])[0])


def in_folds(labelled: DataFrame) -> DataFrame:
    """Written ``labelled(verdict, url)`` with its ``fold``: the urls of a verdict are dealt out in the order of their
    hashes. Rows are numbered within the ranges of a sort; only the ranges' row counts pass the driver."""
    order = ["verdict", "_hash", "url"]
    ranges = labelled.withColumn("_hash", F.xxhash64("url")).repartitionByRange(*order).sortWithinPartitions(*order).drop("_hash")
    struct = StructType([*labelled.select("verdict", "url").schema.fields, *StructType.fromDDL("range int, place long").fields])
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("verdict"), batch.column("url"), pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)),
                                              pa.array(np.arange(done, done + n))], schema=arrow)
            done += n

    placed = written(ranges.select("verdict", "url").mapInArrow(run, struct), "url-places")
    rows = placed.groupBy("verdict", "range").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("verdict", "range").collect()
    before: dict[str, int] = {}
    shifts = []
    for r in rows:
        shifts.append((r["verdict"], r["range"], before.get(r["verdict"], 0) - r["first"]))
        before[r["verdict"]] = before.get(r["verdict"], 0) + r["n"]
    shift = labelled.sparkSession.createDataFrame(shifts, "v string, r int, shift long")
    fold = F.pmod(F.col("place") + F.col("shift"), F.lit(FOLDS)).cast("int")
    return written(placed.join(F.broadcast(shift), (F.col("verdict") == F.col("v")) & (F.col("range") == F.col("r")))
                   .select("verdict", "url", fold.alias("fold")), "urls")


_COUNTS = "n int, context long, byte int, fold int, allow long, block long"


def counted(labelled: DataFrame) -> DataFrame:
    """Written counts (n, context, byte, fold, allow, block) of the distinct urls of ``labelled(verdict, url, fold)``:
    how often a byte follows the ``n`` bytes of a context. Without contexts that both models see too seldom to use."""

    def run(cols: dict) -> dict:
        out: list[list] = [[] for _ in range(6)]
        fold, allow = cols["fold"].to_numpy().astype(np.uint64), np.array([v == "allow" for v in cols["verdict"].to_pylist()], bool)
        texts = [u.encode("utf-8", "replace") for u in cols["url"].to_pylist()]
        if texts:
            codes, first = Markov._codes(texts, ORDER)
            size = np.diff(np.append(first, len(codes[0])))
            # the fold and the verdict of each place
            kind = np.repeat(fold * np.uint64(2) + allow.astype(np.uint64), size)
            for n, code in enumerate(codes):
                by = np.lexsort((kind, code))
                code, k = code[by], kind[by]
                at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (k[1:] != k[:-1])))
                seen, code, k = np.diff(np.append(at, len(k))), code[at], k[at].astype(np.int64)
                for x, v in zip(out, (np.full(len(at), n), (code >> np.uint64(8)).view(np.int64), code & np.uint64(255), k // 2,
                                      seen * (k % 2), seen * (1 - k % 2))):
                    x.append(v)
        return {f: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)).cast(t)
                for f, x, t in zip(("n", "context", "byte", "fold", "allow", "block"), out,
                                   (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))}

    counts = (map_rows(labelled, _COUNTS, run, slice_bytes=1 << 20).groupBy("n", "context", "byte", "fold")
              .agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    return written(_used(written(counts, "url-counts")), "url-used")


def _used(counts: DataFrame) -> DataFrame:
    """The rows of ``counts`` of contexts that a model uses."""
    seen = counts.groupBy(F.col("n").alias("m"), F.col("context").alias("c")).agg(F.sum("allow").alias("x"), F.sum("block").alias("y"))
    return _told(seen.where((F.col("x") >= SEEN) | (F.col("y") >= SEEN)).select("m", "c"), counts).drop("m", "c")


def _told(asks: DataFrame, counts: DataFrame) -> DataFrame:
    """``asks(m, c, ..)`` with the counts of their contexts.

    Both sides are shuffled at every size: they are packed tightly on disk, and Spark takes the contexts of urls for no more
    bytes than the urls, so by its own rule it would send a table of hundreds of MB through the driver."""
    return asks.join(counts.hint("merge"), (F.col("m") == F.col("n")) & (F.col("c") == F.col("context")))


def _in_chunks(urls: DataFrame, chunk: int) -> DataFrame:
    """Written ``urls``, which have a column ``fold``, with the number of a chunk; a chunk has one fold."""
    struct = StructType.fromDDL("chunk long")
    struct = StructType([*urls.schema.fields, *struct.fields])
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            size = np.array([len(u or "") + 1 for u in batch.column("url").to_pylist()], np.int64)
            number = (TaskContext.get().partitionId() << 40) + ((done + np.cumsum(size) - size) // chunk << 4)
            done += int(size.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number + batch.column("fold").to_numpy() + 1)], schema=arrow)

    return written(urls.mapInArrow(run, struct), "url-chunks")


def score(urls: DataFrame, counts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``urls`` and their ``score`` by the models of ``counts`` without the counts of a url's own ``fold`` (-1: of all).

    A null url counts as empty. A task holds a chunk of urls and the counts of its contexts."""
    chunks = _in_chunks(urls, chunk)

    def asked(cols: dict) -> dict:
        number, texts = cols["chunk"].to_numpy(), [(u or "").encode("utf-8", "replace") for u in cols["url"].to_pylist()]
        out: list[list] = [[], [], []]
        for c in np.unique(number):
            for n, code in enumerate(Markov._codes([t for t, x in zip(texts, number) if x == c], ORDER)[0]):
                context = np.unique(code >> np.uint64(8)).view(np.int64)
                for x, v in zip(out, (np.full(len(context), c), np.full(len(context), n), context)):
                    x.append(v)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return {"asker": pa.array(flat[0]), "m": pa.array(flat[1].astype(np.int32)), "c": pa.array(flat[2])}

    asks = map_rows(chunks.select("chunk", "url"), "asker long, m int, c long", asked, slice_bytes=1 << 20).distinct()
    told = _told(asks, counts).select("asker", *counts.columns)
    struct = StructType([*urls.schema.fields, *StructType.fromDDL("score double").fields])
    arrow = _arrow_schema(struct)

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return arrow.empty_table()
        t = {c: told.column(c).to_numpy() for c in told.column_names}
        others = t["fold"] != rows.column("fold")[0].as_py()
        code = (t["context"].astype(np.int64).view(np.uint64) << np.uint64(8)) | t["byte"].astype(np.uint64)
        models = (Markov.of_counts(t["n"], code, np.where(others, t[v], 0)) for v in ("allow", "block"))
        found = ratios(*models, rows.column("url").to_pylist())
        return pa.Table.from_arrays([*(rows.column(n) for n in arrow.names[:-1]), pa.array(found)], schema=arrow)

    return chunks.groupBy("chunk").cogroup(told.groupBy("asker")).applyInArrow(run, struct)


def _cut(at: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """The cut between scores of allowed and blocked urls, with equal weight to both errors; ``a`` and ``b`` are how many
    of them score from at / ``CUTS`` to the next such value, ``low`` and ``high`` the ends of these scores. Of the cuts
    whose error is within two standard errors of the least, the nearest to 0, where both models find a url equally likely:
    few urls can't tell them apart."""
    n, m, negative = a.sum(), b.sum(), np.searchsorted(at, 0)
    cuts = np.concatenate([[0.0, low[0] - 1], (low[1:] + high[:-1]) / 2, [high[-1] + 1]])
    below_a, below_b = (np.concatenate([[x[:negative].sum(), 0], np.cumsum(x)]) for x in (a, b))
    miss, pass_ = below_a / n, 1 - below_b / m
    wrong = miss + pass_
    best = int(np.argmin(wrong))
    # one error more in each keeps the spread from being 0 on few urls
    shares = [((k * p + 1) / (k + 2), k) for k, p in ((n, miss[best]), (m, pass_[best]))]
    good = cuts[wrong <= wrong[best] + 2 * math.sqrt(sum(p * (1 - p) / k for p, k in shares))]
    return float(good[np.argmin(np.abs(good))])


def fit(ruled: DataFrame) -> tuple[DataFrame, float]:
    """(counts, cut) from all distinct urls that the rules decide.

    Each is scored by the models of the other folds, which gives the cut; of the scores, a row for each 1 / ``CUTS`` at
    most passes the driver. With no urls of a kind, its model is uniform; with fewer than ``FOLDS`` the cut is 0."""
    labelled = in_folds(ruled.where(F.col("verdict").isNotNull() & F.col("url").isNotNull()).select("verdict", "url").distinct())
    counts = counted(labelled)
    number = {r["verdict"]: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    if min(number.get(v, 0) for v in ("allow", "block")) < FOLDS:
        return counts, 0.0
    share = F.floor(F.col("score") * CUTS).cast("long")
    rows = (score(labelled, counts, CHUNK * FOLDS).groupBy(share.alias("at"))
            .agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count_if(F.col("verdict") == "allow").alias("a"),
                 F.count_if(F.col("verdict") == "block").alias("b")).orderBy("at").collect())
    return counts, _cut(*(np.array([r[c] for r in rows]) for c in ("at", "low", "high", "a", "b")))


def train(ruled: DataFrame) -> tuple[Markov, Markov, float]:
    """(accept, reject, cut) of :func:`fit`, with both models fetched to the driver, which must be able to hold them."""
    counts, cut = fit(ruled)
    t = counts.toArrow()
    t = {c: t.column(c).to_numpy() for c in t.column_names}
    code = (t["context"].astype(np.int64).view(np.uint64) << np.uint64(8)) | t["byte"].astype(np.uint64)
    return Markov.of_counts(t["n"], code, t["allow"]), Markov.of_counts(t["n"], code, t["block"]), cut


def judge(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page.

    ``score`` is the length-normalised log-likelihood difference (null where a rule decides); a url
    without a rule is allowed if it reaches the calibrated cut. A null url counts as the empty one.
    Repeated rows are judged one by one; other columns are ignored. Neither urls nor models pass the driver.
    """
    ruled = with_rule(pages)
    counts, cut = fit(ruled)
    rest = score(ruled.where(F.col("verdict").isNull()).withColumn("fold", F.lit(-1)), counts)
    judged = rest.withColumn("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    decided = ruled.where(F.col("verdict").isNotNull()).withColumn("score", F.lit(None).cast("double"))
    out = ("page_id", "host", "path", "rule", "verdict", "score")
    return decided.select(*out).union(judged.select(*out))
