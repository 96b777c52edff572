"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded (shape, repetition and hashed word features, then
a learned layer); gated attention weighs the passages, and the weighted representation is scored.
Only document labels are learned from: no passage has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotbank.llm.common import held_out, keep_rows, map_rows

PASSAGE = 64
#: Labelled texts of each class that are trained on, at most (those of the smallest hash of their id).
TRAIN_DOCS = 2000
HIDDEN, GATE, EPOCHS, RATE, DECAY = 24, 12, 40, 5e-3, 1e-4
THRESHOLD = 0.7
#: Bytes of text encoded at a time.
CHUNK = 1 << 20
HASHED = 64

_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
#: Class of each byte: lower, upper, digit, beyond ASCII, control, then each punctuation mark.
CLASS = np.full(256, 4, np.int64)
CLASS[128:] = 3
CLASS[[c for c in range(128) if chr(c).islower()]] = 0
CLASS[[c for c in range(128) if chr(c).isupper()]] = 1
CLASS[48:58] = 2
CLASS[_PUNCT] = 5 + np.arange(len(_PUNCT))
N_CLASS = 5 + len(_PUNCT)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LENGTHS = np.array([2, 3, 5, 8, 12])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POW = np.multiply.accumulate(np.full(1 << 12, _MIX, np.uint64))
N_FEATURES = N_CLASS + len(_LENGTHS) + 1 + 8 + HASHED


def encode(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages per text). A text without words is one passage of zeros."""
    n_docs = len(raws)
    data = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    at = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])[:-1]
    dark = ~SPACE[data]
    starts = np.flatnonzero(dark[1:] & ~dark[:-1]) + 1
    n_words = len(starts)
    doc = np.searchsorted(at, starts, "right") - 1
    per_doc = np.bincount(doc, minlength=n_docs)
    sizes = np.maximum(1, -(-per_doc // PASSAGE))
    n = int(sizes.sum())
    out = np.zeros((n, N_FEATURES))
    if not n_words:
        return out, sizes
    first_word = np.cumsum(per_doc) - per_doc
    first_passage = np.cumsum(sizes) - sizes
    in_doc = np.arange(n_words) - first_word[doc]
    pas = first_passage[doc] + in_doc // PASSAGE
    words = np.bincount(pas, minlength=n)
    some = np.maximum(words, 1)

    chars = data[dark]
    begins = (np.cumsum(dark) - 1)[starts]
    length = np.diff(np.append(begins, len(chars)))
    of = np.repeat(np.arange(n_words), length)
    hist = np.bincount(pas[of] * N_CLASS + CLASS[chars], minlength=n * N_CLASS).reshape(n, N_CLASS)
    out[:, :N_CLASS] = hist / np.maximum(hist.sum(1, keepdims=True), 1)

    k = len(_LENGTHS) + 1
    out[:, N_CLASS:N_CLASS + k] = np.bincount(pas * k + np.searchsorted(_LENGTHS, length), minlength=n * k).reshape(n, k) / some[:, None]

    inside = np.minimum(np.arange(len(chars)) - begins[of], len(_POW) - 1)
    h = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * _POW[inside], begins)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)

    def share(flags: np.ndarray, of_words=pas) -> np.ndarray:
        return np.bincount(of_words, flags, n) / some

    upper = np.add.reduceat((CLASS[chars] == 1).astype(np.int64), begins)
    lower = np.add.reduceat((CLASS[chars] == 0).astype(np.int64), begins)
    again = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    line = (data[starts - 1] == 10) & (in_doc > 0)
    # distinct words of a passage: sorted within it by a key that holds the passage
    by = np.lexsort((h, pas))
    new = np.append(True, (h[by][1:] != h[by][:-1]) | (pas[by][1:] != pas[by][:-1]))
    distinct = np.bincount(pas[by], new, n) / some
    tri = h.copy()
    tri[:-2] += h[1:-1] * np.uint64(5) + h[2:] * np.uint64(17)
    whole = np.append(doc[2:] == doc[:-2], [False] * min(2, n_words))[:n_words]
    by = np.lexsort((tri, doc))
    same = (tri[by][1:] == tri[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    seen = np.zeros(n_words, bool)
    seen[by] = np.append(False, same) | np.append(same, False)
    more = [np.bincount(pas, length, n) / some / 10, share(upper > 0), share((upper > 0) & (lower == 0)), share(again),
            share(line), distinct * (words > 0), share(seen & whole), words / PASSAGE]
    for j, v in enumerate(more):
        out[:, N_CLASS + k + j] = v
    bag = np.bincount(pas * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    out[:, -HASHED:] = bag / some[:, None]
    return out, sizes


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder layer, gated attention (tanh and sigmoid branch) and scorer, in numpy."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        d = x.shape[1]
        init = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"E": init(d, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE),
                  "w": init(GATE, 1), "c": init(HIDDEN, 1), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, sizes: np.ndarray):
        p, first = self.p, np.cumsum(sizes) - sizes
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u @ p["w"])[:, 0]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), sizes))
        a = s / np.repeat(_sum(s, first), sizes)
        z = _sum(a[:, None] * h, first)
        return _sigmoid((z @ p["c"])[:, 0] + p["b"][0]), (x, h, v, u, a, z, first)

    def gradients(self, x, sizes, y, weight) -> dict:
        p = self.p
        score, (x, h, v, u, a, z, first) = self.forward(x, sizes)
        d = weight * (score - y) / weight.sum()
        each = np.repeat(d, sizes)[:, None]
        dz = each * p["c"].T  # gradient of the bag's representation, for each of its passages
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(_sum(a * da, first), sizes))
        dv, du = ds[:, None] * p["w"].T * u * (1 - v * v), ds[:, None] * p["w"].T * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        g = {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds[:, None],
             "c": z.T @ d[:, None], "b": np.array([d.sum()])}
        return {k: g[k] + DECAY * p[k] for k in p}

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 1) -> None:
        """Adam over batches of 64 bags."""
        rng, first = np.random.default_rng(seed), np.cumsum(sizes) - sizes
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), 64):
                bags = order[i:i + 64]
                rows = np.concatenate([np.arange(first[b], first[b] + sizes[b]) for b in bags])
                t += 1
                for k, g in self.gradients(x[rows], sizes[bags], y[bags], weight[bags]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    rate = RATE * (1 - epoch / EPOCHS)
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.99 ** t)) + 1e-8)


def _chunks(texts: pa.Array):
    part, size = [], 0
    for raw in texts.cast(pa.binary()):
        part.append(raw.as_py() or b"")
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, train_docs: int = TRAIN_DOCS) -> Model | None:
    """The model of the labelled rows whose crc32(id as text) mod ``mod`` isn't ``rest``; None without any.

    A bounded sample: at most ``train_docs`` texts of each class, weighted back to the classes'
    shares among all labelled rows. Several labels of an id count by their mean; null labels don't count.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("l"), F.col("quality").cast("double").alias("q"))
             .where("l is not null and q is not null and q between 0 and 1").where(~held_out(F.col("l"), mod, rest))
             .groupBy("l").agg((F.avg("q") >= 0.5).cast("int").alias("y")))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = None
    for y in n:
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("l"), "l").limit(train_docs)
        some = part if some is None else some.union(part)
    if some is None:
        return None

    def run(cols: dict) -> dict:
        xs, out = [], {"y": [], "n": [], "x": []}
        for raws in _chunks(cols["text"]):
            x, sizes = encode(raws)
            xs += [v.astype(np.float32).tobytes() for v in np.split(x, np.cumsum(sizes)[:-1])]
            out["n"] += sizes.tolist()
        return {"y": cols["y"], "n": out["n"], "x": pa.array(xs, pa.binary()), "l": cols["l"]}

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"))
    # at most 2 * train_docs small rows are shipped; a repeated id is trained on once
    found = map_rows(rows.join(F.broadcast(some), F.col("d") == F.col("l")).select("l", "y", "text"),
                     "l long, y int, n int, x binary", run).orderBy("l", "x").toPandas().drop_duplicates("l")
    if not len(found):
        return None
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, N_FEATURES).astype(float)
    y = found["y"].to_numpy(float)
    weight = np.where(y > 0, n.get(1, 0) / max(1, (y > 0).sum()), n.get(0, 0) / max(1, (y == 0).sum()))
    model = Model(x)
    model.fit(x, found["n"].to_numpy(), y, weight / weight.mean())
    return model


def score(docs: DataFrame, model: Model | None, mod: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, attended) of every row; ``attended`` is the place
    of the passage with the largest weight.

    Null and empty texts are one passage without words; without a model every score is 0.5. Repeated rows
    are scored one by one, other columns are ignored. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols: dict) -> dict:
        m, out = shared.value, {k: [] for k in ("score", "predicted", "n_passages", "attended")}
        for raws in _chunks(cols["text"]):
            x, sizes = encode(raws)
            if m is None:
                s, a = np.full(len(sizes), 0.5), np.zeros(len(x))
            else:
                s, (*_, a, _, _) = m.forward(x, sizes)
            first = np.cumsum(sizes) - sizes
            out["score"] += s.tolist()
            out["predicted"] += (s >= THRESHOLD).astype(int).tolist()
            out["n_passages"] += sizes.tolist()
            out["attended"] += [int(np.argmax(a[f:f + k])) for f, k in zip(first, sizes)]
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], **out}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), mod, rest).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int, n_passages int, attended int", run)


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; without a model all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols: dict) -> list[bool]:
        m, out = shared.value, []
        for raws in _chunks(cols["text"]):
            out += [True] * len(raws) if m is None else (m.forward(*encode(raws))[0] >= THRESHOLD).tolist()
        return out

    return keep_rows(docs, ["text"], run)


def score_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled training rows and score every row (see :func:`train`, :func:`score`)."""
    return score(docs, train(docs, labels))
