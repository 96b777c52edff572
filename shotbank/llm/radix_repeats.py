"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix of every text is ordered only through its first ``depth`` bytes, by passes from the
most significant digit on; suffixes that share no digit with another leave, and the groups that are
equal after the last pass are the repeated windows.

Groups of equal prefixes do not depend on the order in which the bytes of the prefix are
looked at, as long as it is the same for equal prefixes. So the most significant digit of a suffix is
its *anchor*: the ``GRAM`` bytes with the smallest hash within its first ``depth`` bytes, and how
far from the start they lie. Neighbouring suffixes mostly have the same anchor, and such a run is one
row (about one per 180 bytes of text) rather than a row per suffix. Passes:

1. runs are grouped by the bytes of their anchor; runs alone in their group leave;
2. runs are cut into blocks of at most 64, then 8, then 1 suffixes at fixed distances from the anchor.
   Blocks with equal *hulls* (all bytes that their windows cover) hold repeated windows only: they are
   settled, and one of each such group goes on as the partner of others. Blocks whose *core* (the bytes
   common to their windows) occurs in one hull only hold no repeated window: they leave.
   The rest goes on to the next, smaller size; at size 1 hull and window are the same bytes.

Hulls are compared by 128-bit hashes; shorter hashes only ever let a run go on for longer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotbank.llm.common import map_rows, written

DEPTH = 400
GRAM = 48
BLOCKS = (64, 8, 1)
#: Bytes of a text whose anchors are found at once (with an overlap); bounds a task's memory.
CHUNK = 1 << 22

_MUL = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict = {}


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` bytes of ``data`` (rolling polynomial, then mixed)."""
    n = len(data)
    if _POW.get("n", 0) < n + 1:
        m = 1 << (n + 1).bit_length()
        _POW.update(n=m, up=_powers(m, _MUL), down=_powers(m, _INV))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW["down"][:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _POW["up"][:n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    n = len(v)
    pad = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    pad[:n] = v
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray, depth: int = DEPTH, gram: int = GRAM):
    """Arrays (hash, q, lo, hi): the windows that start at lo..hi have their anchor at q."""
    hs, qs, los, his = [], [], [], []
    last = len(data) - depth
    for at in range(0, last + 1, CHUNK):
        part = data[at:min(len(data), at + CHUNK + depth - 1)]
        h = gram_hashes(part, gram)
        pos = np.arange(len(h), dtype=np.uint64)
        low = window_min((h & np.uint64(0xFFFFFFFF00000000)) | pos, depth - gram + 1)
        q = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        end = np.append(first[1:], len(q)) - 1
        hs.append(h[q[first]].view(np.int64))
        qs.append(q[first] + at)
        los.append(first + at)
        his.append(end + at)
    if not hs:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in (hs, qs, los, his))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row is known by its id and the hash of its text; rows that agree in both are alike in all results."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _raw(col) -> list[bytes]:
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def _join_texts(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` with ``rows`` (one per document): the same shuffled join at every size."""
    rows = rows.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "runs")
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), how).drop("d", "t")


def _per_doc(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*cols)).alias("runs"))


def _find_anchors(depth: int, gram: int):
    def run(cols: dict) -> dict:
        ids, ths = cols["doc_id"].to_pylist(), cols["th"].to_pylist()
        out = {k: [] for k in ("h", "q", "lo", "hi")}
        n = []
        for raw in _raw(cols["text"]):
            found = anchors(np.frombuffer(raw, np.uint8), depth, gram) if len(raw) >= depth else (np.zeros(0, np.int64),) * 4
            n.append(len(found[0]))
            for k, v in zip(out, found):
                out[k].append(v)
        index = pa.array(np.repeat(np.arange(len(n)), n))
        return {"doc_id": pa.array(ids, pa.int64()).take(index), "th": pa.array(ths, pa.int64()).take(index),
                **{k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for k, v in out.items()}}

    return run


def _cut(size: int, depth: int):
    """Blocks of at most ``size`` windows, each at the same distances from the anchor in every text."""

    def run(cols: dict) -> dict:
        out = {k: [] for k in ("doc_id", "th", "q", "s", "e", "core", "hull")}
        for doc, th, raw, runs in zip(cols["doc_id"].to_pylist(), cols["th"].to_pylist(), _raw(cols["text"]),
                                      cols["runs"].to_pylist()):
            for r in runs:
                q, lo, hi = r["q"], r["lo"], r["hi"]
                for j in range((q - hi) // size, (q - lo) // size + 1):
                    near, far = j * size, j * size + size - 1  # distances to the anchor, in any text
                    s, e = max(lo, q - far), min(hi, q - near)
                    out["doc_id"].append(doc)
                    out["th"].append(th)
                    out["q"].append(q)
                    out["s"].append(s)
                    out["e"].append(e)
                    core = raw[max(q - near, 0):q - far + depth]
                    out["core"].append(xxhash.xxh3_64_intdigest(core, seed=j) - (1 << 63))
                    out["hull"].append(xxhash.xxh3_128_digest(raw[s:e + depth] + b"%d,%d" % (q - s, q - e)))
        return out

    return run


def repeated_runs(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, s, e): the windows of ``depth`` bytes that start at s..e also start elsewhere.

    ``docs`` is what ``_keyed`` returns. Texts shorter than ``depth`` have no window.
    """
    runs = written(map_rows(docs.where(F.octet_length("text") >= depth),
                            "doc_id long, th long, h long, q long, lo long, hi long", _find_anchors(depth, gram)), "runs")
    # groups are written before they are joined with their rows, so that Spark can split a hot one
    shared = written(runs.groupBy("h").count().where("count > 1").select(F.col("h").alias("g")), "shared")
    runs = runs.join(shared, F.col("h") == F.col("g"))
    out = None
    for size in BLOCKS:
        pending = written(_per_doc(runs, "q", "lo", "hi"), "pending")
        nodes = written(map_rows(_join_texts(docs, pending, "inner"),
                                 "doc_id long, th long, q long, s long, e long, core long, hull binary",
                                 _cut(size, depth)), "blocks")
        hulls = nodes.groupBy("hull").agg(F.count("*").alias("n"), F.min("core").alias("core"),
                                          F.min(F.struct("doc_id", "th", "q", "s", "e")).alias("one"))
        hulls = written(hulls, "hulls")
        same = hulls.where("n > 1").select(F.col("hull").alias("g"))
        settled = nodes.join(same, F.col("hull") == F.col("g")).select("doc_id", "th", "s", "e")
        out = settled if out is None else out.union(settled)
        if size == BLOCKS[-1]:
            break
        open_cores = written(hulls.groupBy("core").count().where("count > 1").select(F.col("core").alias("g")), "cores")
        runs = (hulls.join(open_cores, F.col("core") == F.col("g"))
                .select("one.doc_id", "one.th", "one.q", F.col("one.s").alias("lo"), F.col("one.e").alias("hi")))
    return out


def _merge(runs: list, depth: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["s"], r["e"] + depth) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, text, spans): the maximal byte runs [a, b) of each text that strings of ``depth`` bytes
    cover which also start elsewhere, in the same text or another.

    A null text counts as the empty one. Rows with equal id and text are each other's copies: one of them is
    sorted with the others' suffixes, and all of them are covered as a whole. Other
    columns are ignored. Group sizes never matter: all groups are aggregated to one row or joined, and
    rows are collected per document only (at most one for each byte of its text).
    """
    keyed = _keyed(docs, id_col, text_col)
    # ids and hashes only
    again = written(keyed.groupBy(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th")).agg(F.count("*").alias("rows"))
                    .where("rows > 1"), "again")
    same = F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("th") == F.col("a_th"))
    once = keyed
    if not again.isEmpty():
        once = keyed.join(again, same, "left_anti").union(keyed.join(again, same, "left_semi").dropDuplicates(["doc_id", "th"]))
    found = written(_per_doc(repeated_runs(once, depth).distinct(), "s", "e"), "spans")

    def run(cols: dict) -> dict:
        spans = []
        for size, r, n in zip(cols["size"].to_pylist(), cols["runs"].to_pylist(), cols["rows"].to_pylist()):
            pairs = [(0, size)] if n and size >= depth else _merge(r or [], depth)
            spans.append([{"a": a, "b": b} for a, b in pairs])
        return {"doc_id": cols["doc_id"], "text": cols["text"], "spans": spans}

    rows = _join_texts(keyed, found, "left").join(again, same, "left").withColumn("size", F.octet_length("text").cast("long"))
    return map_rows(rows.select("doc_id", "text", "size", "runs", "rows"), "doc_id long, text string, spans array<struct<a: long, b: long>>", run)


def dedup_digest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The digest columns of :func:`removed_spans`, a hash of the bytes that are left, and whether any were removed."""

    def run(cols: dict) -> dict:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for raw, spans in zip(_raw(cols["text"]), cols["spans"].to_pylist()):
            at, sha, gone = 0, hashlib.sha256(), 0
            for s in spans:
                sha.update(raw[at:s["a"]])
                at, gone = s["b"], gone + s["b"] - s["a"]
            sha.update(raw[at:])
            for k, v in zip(out, (len(raw), gone, len(spans), sha.hexdigest())):
                out[k].append(v)
        return {"doc_id": cols["doc_id"], **out, "removed": [n > 0 for n in out["n_removed"]]}

    return map_rows(removed_spans(docs, depth=depth),
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed boolean", run)
