"""Toxicity of texts that may be disguised: a noisy channel is decoded first, the restored text is scored.

What is written may stand for other characters: leetspeak (``1d10t``), characters between letters (``i.d i-o_t``) and
repeated letters (``idiooot``). Each such stretch is a character lattice, and the Viterbi path under a character model
(Witten-Bell smoothed, three characters of context) and the channel's probabilities restores it. A stretch whose
lattice has one path only, such as a plain word, is its own restoration. The character model is counted over all
texts; its symbols are the letters a-z without marks, any other letter, any digit and the end of a word, so its table has the
same size for every corpus.

The restored words and their beginnings are hashed, and a logistic model of the counts of the most telling ones gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shotbank.llm.common import _arrow_schema, held_out, map_rows, written

THRESHOLD = 0.3
#: Labelled texts of each class that are trained on, at most (those of the smallest hash of their id).
TRAIN_DOCS = 3000
#: Features of the model, and of the hash.
FEATURES, HASHED = 3000, 1 << 20
BEGINNINGS = (3, 4, 5, 6, 7)
STEPS, RATE, DECAY = 300, 0.05, 3e-3
#: Distinct tokens that a task remembers, and characters of a text that are read at a time.
MEMO, SLICE = 400_000, 1 << 20

OTHER, DIGIT, END = 26, 27, 28
SYMBOLS = 29
CONTEXT = SYMBOLS ** 3

# Letters that digits and signs are written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: The channel: a digit that is meant; a sign that is a letter; a character between letters that means nothing (else a word
#: ends there); three or more equal letters that are one (else two).
MEANT, SIGN, NOISE, ONE = 0.7, 0.8, 0.8, 0.6

_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: What is decoded of a token: from its first letter, digit or leading sign to the last.
_CORE = re.compile(r"[\w@$].*[\w@$]", re.S)
_RUN = re.compile(r"([^\W\d_])\1\1")
#: Three or more single characters with one or two others between them.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|])(?:[ .\-_*~,]{1,2}(?:[^\W_]|[@$!|])(?![^\W_])){2,}")
_SAFE_CUT = re.compile(r"(?<=\w\w)\s(?=\w\w)")


class _Folded(dict):
    def __missing__(self, c: str) -> int:
        plain = unicodedata.normalize("NFKD", c)[:1].lower()
        self[c] = s = ord(plain) - 97 if "a" <= plain <= "z" else DIGIT if c.isdigit() else OTHER
        return s


FOLD = _Folded()


def count_words(words: Counter) -> np.ndarray:
    """How often each symbol follows each three (places of a flat table) in the words, with three ends before each word."""
    if not words:
        return np.zeros(CONTEXT * SYMBOLS)
    pad = "\0" * 3
    points = np.frombuffer((pad + pad.join(words) + pad).encode("utf-32-le", "replace"), np.uint32)
    known, back = np.unique(points, return_inverse=True)
    s = np.array([FOLD[chr(c)] if c else END for c in known], np.int64)[back]
    length = np.fromiter(map(len, words), np.int64, len(words))
    # each word's letters and the first end after it are counted, not the next two
    counted = np.ones(len(s), bool)
    counted[:3] = False
    ends = 3 + np.cumsum(length + 3) - 3
    counted[ends + 1] = counted[ends + 2] = False
    codes = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
    times = np.repeat(np.fromiter(words.values(), float, len(words)), length + 1)
    return np.bincount(codes[counted[3:]], times, CONTEXT * SYMBOLS)


class CharModel:
    """Log-probability of a symbol after three others."""

    def __init__(self, counts: np.ndarray):
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        counts = counts.reshape((SYMBOLS,) * 4)
        for known in range(4):
            c = counts.sum(axis=tuple(range(3 - known))).reshape(-1, SYMBOLS)
            seen, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            lower = np.tile(p.reshape(-1, SYMBOLS), (len(c) // p.reshape(-1, SYMBOLS).shape[0], 1))
            p = np.where(seen > 0, (c + kinds * lower) / np.maximum(seen + kinds, 1), lower)
        self.logp = np.log(p).ravel().astype(np.float32)

    def lattice(self, s: str) -> list[list[tuple[int, str, float]]]:
        """Per place of ``s`` its edges (next place, characters, log-probability of the channel); the blank ends a word."""
        out: list[list] = [[] for _ in s]
        i = 0
        while i < len(s):
            c, j = s[i], i + 1
            if c.isalpha():
                while j < len(s) and s[j] == c:
                    j += 1
                if j - i >= 3:
                    out[i] = [(j, c, math.log(ONE)), (j, c * 2, math.log(1 - ONE))]
                else:
                    out[i] = [(j, s[i:j], 0.0)]
                i = j
                continue
            if c.isdigit():
                letters = LEET.get(c, "")
                out[i] = [(j, c, math.log(MEANT) if letters else 0.0)]
                out[i] += [(j, x, math.log((1 - MEANT) / len(letters))) for x in letters]
            else:
                letters = LEET.get(c, "")
                rest = 1 - SIGN if letters else 1.0
                out[i] = [(j, x, math.log(SIGN / len(letters))) for x in letters]
                out[i] += [(j, "", math.log(NOISE * rest)), (j, " ", math.log((1 - NOISE) * rest))]
            i = j
        return out

    def decode(self, s: str) -> str:
        """The Viterbi path; of paths that are equally likely the first in the order of their restored texts."""
        start = END * (SYMBOLS * SYMBOLS + SYMBOLS + 1)
        edges = self.lattice(s)
        # per place: state -> (cost, edge's characters, state and place before)
        at: list[dict] = [{} for _ in range(len(s) + 1)]
        at[0][start] = (0.0, "", None, None)
        logp = self.logp
        for i, out in enumerate(edges):
            for state, (cost, *_) in at[i].items():
                for j, chars, channel in out:
                    to, c = state, cost - channel
                    for x in chars:
                        if x == " ":
                            if to != start:  # the end of a word; the next one begins
                                c -= float(logp[to * SYMBOLS + END])
                                to = start
                        else:
                            y = FOLD[x]
                            c -= float(logp[to * SYMBOLS + y])
                            to = (to * SYMBOLS + y) % CONTEXT
                    old = at[j].get(to)
                    if old is None or (c, chars) < old[:2]:
                        at[j][to] = (c, chars, state, i)
        ends = [(cost - (0.0 if state == start else float(logp[state * SYMBOLS + END])), chars, state)
                for state, (cost, chars, _, _) in at[len(s)].items()]
        state, i, out = min(ends)[2], len(s), []
        while i:
            _, chars, state, i = at[i][state]
            out.append(chars)
        return "".join(reversed(out)).strip()


class Reader:
    """Restored tokens of texts, with a memory of those seen."""

    def __init__(self, model: CharModel):
        self.model, self.memo, self.hashes = model, {}, _Hashes()

    def token(self, t: str) -> str:
        """What a token stands for."""
        core = t
        if not t.isalpha():
            found = _CORE.search(t)
            core = found.group() if found else t
        if core.isalpha() and not _RUN.search(core) or not _LETTERS.search(core):
            return t
        return t.replace(core, self.model.decode(core), 1)

    def tokens(self, text: str | None) -> Iterator[list[str]]:
        """The lower-cased tokens of parts of a text; single characters that follow one another are restored."""
        text = (text or "").lower()
        at = 0
        while at < len(text):
            cut = _SAFE_CUT.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            yield _SPACED.sub(lambda m: self.model.decode(m.group()), text[at:end]).split()
            at = end

    def restored(self, text: str | None) -> str:
        return " ".join(self.token(t) for part in self.tokens(text) for t in part)

    def features(self, text: str | None, places: dict[int, int] | None = None) -> Counter:
        """How often each hashed feature is in the text; with ``places`` only those, by their place."""
        out: Counter = Counter()
        for part in self.tokens(text):
            for t, n in Counter(part).items():
                got = self.memo.get(t)
                if got is None:
                    got = [h for w in _LETTERS.findall(self.token(t)) for h in self.hashes.of(w)]
                    if places is not None:
                        got = [places[h] for h in got if h in places] or _NONE
                    if len(t) <= 64:
                        if len(self.memo) >= MEMO:
                            self.memo.clear()
                        self.memo[t] = got
                for h in got:
                    out[h] += n
        return out


_NONE: list[int] = []


def hashed(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "replace")) % HASHED


class _Hashes(dict):
    """The hashes of beginnings, remembered."""

    def __missing__(self, beginning: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[beginning] = h = hashed(beginning)
        return h

    def of(self, word: str) -> list[int]:
        """The features of a word: the whole, and its beginnings."""
        return [hashed("=" + word), *[self[word[:k]] for k in BEGINNINGS if len(word) >= k]]


class Model:
    """Logistic model of log(1 + count) of the chosen features."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features)
        self.w, self.b = np.zeros(len(features)), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Full-batch Adam with decay."""
        x, weight = x.astype(np.float32), (weight / weight.sum()).astype(np.float32)
        p = np.zeros(len(self.w) + 1, np.float32)
        m, s = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, STEPS + 1):
            e = weight * (_sigmoid(x @ p[:-1] + p[-1]) - y).astype(np.float32)
            g = np.append(e @ x + DECAY * p[:-1], e.sum())
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            p -= RATE * (1 - t / STEPS) * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
        self.w, self.b = p[:-1].astype(float), float(p[-1])

    def score(self, counts: Counter) -> float:
        return float(_sigmoid(sum(self.w[f] * math.log1p(n) for f, n in sorted(counts.items())) + self.b))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """The character model of all texts. A task adds its words up in a table of fixed size."""
    struct = StructType.fromDDL("code int, n double")
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = np.zeros(CONTEXT * SYMBOLS), Counter()
        for batch in batches:
            for t in batch.column(0):
                text = (t.as_py() or "").lower()
                for lo in range(0, len(text), SLICE):
                    words.update(_WORD.findall(text[lo:lo + SLICE]))
                    if len(words) > MEMO:
                        table += count_words(words)
                        words.clear()
        table += count_words(words)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(table[some])], schema=arrow)

    # at most SYMBOLS ** 4 rows
    got = docs.select(F.col(text_col).cast("string")).mapInArrow(run, struct).groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CONTEXT * SYMBOLS)
    counts[got["code"].to_numpy(np.int64)] = got["n"].to_numpy()
    return CharModel(counts)


def train(docs: DataFrame, labels: DataFrame, chars: CharModel, mod: int = 4, rest: int = 2, train_docs: int = TRAIN_DOCS) -> Model | None:
    """The model of the labelled rows whose crc32(id as text) mod ``mod`` isn't ``rest``; None unless both classes occur.

    A bounded sample: at most ``train_docs`` texts of each class, weighted back to the classes' shares among all
    labelled rows. Several labels of an id count by their mean; null labels don't count. Of several texts of an id one is used.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("l"), F.col("toxic").cast("double").alias("q"))
             .where("l is not null and q is not null and q between 0 and 1").where(~held_out(F.col("l"), mod, rest))
             .groupBy("l").agg((F.avg("q") >= 0.5).cast("int").alias("y")))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("l"), "l").limit(train_docs) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most 2 * train_docs small rows are shipped
    texts = (rows.join(F.broadcast(some[0].union(some[1])), F.col("d") == F.col("l"))
             .groupBy("l", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def run(cols: dict) -> dict:
        reader = _reader(shared.value)
        found = [reader.features(t) for t in cols["text"].to_pylist()]
        return {"l": cols["l"], "y": cols["y"], "f": [list(c) for c in found], "n": [list(c.values()) for c in found]}

    sample = written(map_rows(texts, "l long, y int, f array<int>, n array<int>", run), "toxic-sample")
    held = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(held) < 2:
        return None
    p, q = F.count_if(F.col("y") == 1) / held[1], F.count_if(F.col("y") == 0) / held[0]
    telling = F.abs(F.sqrt(p) - F.sqrt(q))
    chosen = (sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(telling.alias("telling"))
              .orderBy(F.desc("telling"), "f").limit(FEATURES).toPandas()["f"].to_numpy(np.int64))
    model = Model(chosen)
    place = docs.sparkSession.sparkContext.broadcast(model.features)

    def pick(cols: dict) -> dict:
        out = {"l": cols["l"], "y": cols["y"], "f": [], "n": []}
        for f, n in zip(cols["f"], cols["n"]):
            f, n = f.values.to_numpy(), n.values.to_numpy()
            at = np.minimum(np.searchsorted(place.value, f), len(place.value) - 1)
            mine = place.value[at] == f
            out["f"].append(at[mine])
            out["n"].append(n[mine])
        return out

    got: pd.DataFrame = map_rows(sample, "l long, y int, f array<int>, n array<int>", pick).orderBy("l").toPandas()
    x = np.zeros((len(got), len(chosen)), np.float32)
    for i, (f, c) in enumerate(zip(got["f"], got["n"])):
        x[i, np.asarray(f, np.int64)] = np.log1p(np.asarray(c, float))
    y = got["y"].to_numpy(float)
    model.fit(x, y, np.where(y > 0, n[1] / held[1], n[0] / held[0]))
    return model


_HELD: list = [None, None]


def _reader(value) -> Reader:
    """One per broadcast value and worker, so that tokens are remembered from batch to batch."""
    if _HELD[0] is not value:
        _HELD[:] = value, Reader(value if isinstance(value, CharModel) else value[0])
    return _HELD[1]


def restore(docs: DataFrame, chars: CharModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, restored): each text in lower case with its disguised words restored; white space is one blank."""
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def run(cols: dict) -> dict:
        reader = _reader(shared.value)
        return {"doc_id": cols["doc_id"], "restored": [reader.restored(t) for t in cols["text"].to_pylist()]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                    "doc_id long, restored string", run, slice_bytes=8 << 20)


def score(docs: DataFrame, chars: CharModel, model: Model | None, mod: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have no features; without a model every score is 0. Repeated rows are scored one by one, other
    columns are ignored, and nothing is shuffled. A text is read in slices of ``SLICE`` characters, cut between words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((chars, model))

    def run(cols: dict) -> dict:
        chars, m = shared.value
        reader = _reader(shared.value)
        places = {int(f): i for i, f in enumerate(m.features)} if m else {}
        s = [m.score(reader.features(t.as_py(), places)) if m else 0.0 for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": s, "predicted": [int(x >= THRESHOLD) for x in s]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), mod, rest).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int", run)


def score_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Count the characters of all texts, learn from the labelled training rows and score every row."""
    chars = char_model(docs)
    return score(docs, chars, train(docs, labels, chars))
