"""A backoff language model as a weighted automaton, learned from and applied to whole corpora.

States are the n-grams of the training texts (and the start of a text); an arc (state, word) carries a probability, and
every state has a failure arc to its longest proper suffix with a weight. The probabilities are smoothed by a prior
of ``PRIOR`` occurrences that are drawn from the shorter context (Dirichlet): with c(h) occurrences of a state, the arc to w has
(c(hw) + K p(w | shorter)) / (c(h) + K) and the failure arc weighs K / (c(h) + K), so each state's probabilities sum to
one. The unigram state has an arc for every word. A text is read from left to right: the state after a token is the
bigram that ends there, and its arc or, by the failure arcs, the arcs of shorter states give the next token's probability.

Every n-gram of every training text counts, once or a million times, at every size: nothing is cut and no model is
shipped. Texts are dealt into chunks, which number their distinct words, bigrams and trigrams. A chunk sorts the hashes of
its n-grams and sends them, packed, to ranges of hashes, where the counts of all chunks are added up; what other chunks
counted comes back packed in the same order. A trigram is sent only if other chunks hold both of its bigrams. The chunks
stay where they were written, in buckets by number; only what comes back is shuffled to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shotbank.llm.common import _arrow_schema, bucketed, held_out, written

#: Occurrences that the shorter context counts for in a bigram and in a trigram.
PRIOR = (2000.0, 3.0)
#: Bytes of text in a chunk, at least (a longer text is a chunk of its own).
CHUNK = 8 << 20
#: Tokens of the corpus for each range of hashes; a range holds fewer n-grams of an order.
RANGE = 1 << 21
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = b""  # no word is empty
START = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, then the end mark."""
    out = WORD.findall((text or "").encode("utf-8", "replace").lower())
    out.append(END)
    return out


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    h = x * np.uint64(0xBF58476D1CE4E5B9) + y
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Texts as numbers: distinct words, bigrams and trigrams of a chunk, and the place of each in its texts.

    ``words`` are the words' hashes, ``token`` each token's word, ``sizes`` the tokens of each text, ``held`` the texts
    that are not learned from. A bigram is (word before or the start, word); a trigram (bigram before, word)."""

    def __init__(self, words: np.ndarray, token: np.ndarray, sizes: np.ndarray, held: np.ndarray):
        self.words, self.token, self.sizes = words, token.astype(np.int64), sizes
        self.first = np.cumsum(sizes) - sizes
        self.start = np.zeros(len(token), bool)
        self.start[self.first] = True
        self.learned = np.repeat(~held, sizes).astype(float)
        self.n1 = np.bincount(self.token, self.learned, len(words)).astype(np.int64)
        self.before = np.where(self.start, len(words), np.append(-1, self.token[:-1])) if len(token) else self.token

    def bigrams(self) -> None:
        width = len(self.words) + 1
        code, self.bigram = np.unique(self.before * width + self.token, return_inverse=True)
        before, word = code // width, code % width
        self.key2 = _mixed(np.append(self.words, START)[before], self.words[word])
        self.n2 = np.bincount(self.bigram, self.learned, len(code)).astype(np.int64)

    def trigrams(self) -> None:
        """Of the tokens that have two before them, the start of the text counted."""
        width = len(self.words) + 1
        self.later = np.flatnonzero(~self.start)
        context = self.bigram[self.later - 1]
        code, self.trigram = np.unique(context * width + self.token[self.later], return_inverse=True)
        self.context3 = code // width
        self.key3 = _mixed(self.key2[self.context3], self.words[code % width])
        self.n3 = np.bincount(self.trigram, self.learned[self.later], len(code)).astype(np.int64)
        # the bigram that a trigram ends with
        self.last3 = np.zeros(len(code), np.int64)
        self.last3[self.trigram] = self.bigram[self.later]

    def asked(self, shared: np.ndarray) -> np.ndarray:
        """The trigrams both of whose bigrams other chunks hold, too."""
        return np.flatnonzero(shared[self.context3] & shared[self.last3])

    def score(self, total1: np.ndarray, total2: np.ndarray, total3: np.ndarray, tokens_: int, kinds: int, texts: int) -> tuple:
        """(n_known, base, score) per text from the corpus-wide counts."""
        p = ((total1 + 1) / (tokens_ + kinds + 1))[self.token]
        base = np.log10(p)
        seen = np.append(total1, texts)[self.before]
        p = np.where(seen > 0, (total2[self.bigram] + PRIOR[0] * p) / (seen + PRIOR[0]), p)
        if len(self.later):
            seen, low = total2[self.bigram[self.later - 1]], p[self.later]
            p[self.later] = np.where(seen > 0, (total3[self.trigram] + PRIOR[1] * low) / (seen + PRIOR[1]), low)
        known = (total1[self.token] > 0).astype(np.int64)
        return tuple(np.add.reduceat(x, self.first) if len(self.first) else x[:0] for x in (known, base, np.log10(p)))


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte by byte: first the lowest bytes of all, last the highest, which often are all the same."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first from 0; ``np.cumsum`` undoes it."""
    return np.diff(x, prepend=np.zeros(1, x.dtype))


_CHUNKS = ("chunk long, doc_id array<long>, held array<boolean>, sizes array<long>, n_words long, words binary, "
           "n_tokens long, token binary, learned long, texts long")
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _row(out: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([out[f.name]], f.type) for f in arrow], schema=arrow)


def chunks(docs: DataFrame) -> DataFrame:
    """Written chunks of ``docs(doc_id, held_out, text)``."""
    struct = StructType.fromDDL(_CHUNKS)
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list, list] = ([], [], [], [])
        words, size = _Numbers(), 0

        def row() -> pa.RecordBatch:
            ids, out, sizes, token = held
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
            token = np.concatenate(token)
            # the most frequent words have the smallest numbers
            order = np.lexsort((hashes, -np.bincount(token, minlength=len(hashes))))
            number_of = np.empty(len(order), np.int32)
            number_of[order] = np.arange(len(order))
            learned = [n for n, h in zip(sizes, out) if not h]
            return _row({"chunk": number, "doc_id": ids, "held": out, "sizes": sizes, "n_words": len(hashes),
                         "words": _pack(_steps(hashes[order])), "n_tokens": len(token), "token": _pack(number_of[token]),
                         "learned": sum(learned), "texts": len(learned)}, arrow)

        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = t.as_py()
                ws = tokens(text)
                for x, v in zip(held, (i, h, len(ws), np.fromiter(map(words.__getitem__, ws), np.int32, len(ws)))):
                    x.append(v)
                size += len(text or "") + 100
                if size >= CHUNK:
                    yield row()
                    held, words, size, number = ([], [], [], []), _Numbers(), 0, number + 1
        if held[0]:
            yield row()

    return bucketed(docs.select("doc_id", "held_out", "text").mapInArrow(run, struct), "chunk", "lm-chunks")


def _read(batch: pa.RecordBatch, names: list[str], i: int) -> dict:
    """A row's columns; arrays as numpy."""
    out = {}
    for n, column in zip(names, batch.columns):
        v = column[i]
        if not pa.types.is_list(column.type) or n == "found":
            out[n] = v.as_py()
        else:  # ids may be null
            out[n] = v.values if n == "doc_id" else v.values.to_numpy(zero_copy_only=False)
    return out


def _chunk(r: dict) -> Chunk:
    return Chunk(np.cumsum(_unpack(r["words"], r["n_words"], np.uint64), dtype=np.uint64),
                 _unpack(r["token"], r["n_tokens"], np.int32), r["sizes"], r["held"].astype(bool))


def _over_chunks(table: DataFrame, schema: str, fn) -> DataFrame:
    """The record batches (dicts of columns) that ``fn(row)`` yields for each chunk."""
    struct = StructType.fromDDL(schema)
    arrow, names = _arrow_schema(struct), table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for out in fn(_read(batch, names, i)):
                    yield pa.RecordBatch.from_arrays(
                        [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return table.mapInArrow(run, struct)


_GRAMS = "chunk long, size int, range int, n long, key binary, own binary"
_TOTALS = "chunk long, size int, range int, n long, more binary, distinct long"


def _grams(chunk: int, size: int, key: np.ndarray, own: np.ndarray, ranges: int) -> Iterator[dict]:
    """A chunk's n-grams of ``size`` words by ranges of their keys, in the order of the keys."""
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    of = ((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    ends = np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))
    for i in np.flatnonzero(np.diff(ends)):
        part = slice(ends[i], ends[i + 1])
        yield {"chunk": [chunk], "size": [size], "range": [i], "n": [part.stop - part.start],
               "key": [_pack(_steps(key[part]))], "own": [_pack(own[part])]}


def _short_grams(r: dict, ranges: int) -> Iterator[dict]:
    c = _chunk(r)
    c.bigrams()
    yield from _grams(r["chunk"], 1, c.words, c.n1, ranges)
    yield from _grams(r["chunk"], 2, c.key2, c.n2, ranges)


def _trigrams(r: dict, ranges: int) -> Iterator[dict]:
    c = _chunk(r)
    c.bigrams()
    c.trigrams()
    ask = c.asked(_found(r, 2, c.key2, c.n2)[1])
    yield from _grams(r["chunk"], 3, c.key3[ask], c.n3[ask], ranges)


def _totals(grams: DataFrame) -> DataFrame:
    """For each row of ``grams`` what other chunks counted of its n-grams: twice the number, and one if any holds it.
    ``distinct`` of a range's rows adds up to its n-grams that are learned from. A key has one row per chunk at most."""
    arrow = _arrow_schema(StructType.fromDDL(_TOTALS))

    def add(rows: pa.Table) -> pa.Table:
        sizes = rows["n"].to_pylist()
        key, own = np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), np.int64)
        ends = np.cumsum(sizes)
        for end, n, k, o in zip(ends, sizes, rows["key"], rows["own"]):
            key[end - n:end] = np.cumsum(_unpack(k.as_py(), n, np.uint64), dtype=np.uint64)
            own[end - n:end] = _unpack(o.as_py(), n, np.int64)
        order = np.argsort(key, kind="stable")
        key, counts = key[order], own[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        holders, total = np.diff(np.append(first, len(key))), np.add.reduceat(counts, first)
        more = np.empty(len(key), np.int64)
        more[order] = 2 * (np.repeat(total, holders) - counts) + np.repeat(holders > 1, holders)
        distinct = [int(np.count_nonzero(total))] + [0] * (len(sizes) - 1)
        return pa.table([rows["chunk"], rows["size"], rows["range"], rows["n"],
                         pa.array([_pack(more[end - n:end]) for end, n in zip(ends, sizes)], pa.binary()),
                         pa.array(distinct, pa.int64())], schema=arrow)

    return grams.groupBy("size", "range").applyInArrow(add, _TOTALS)


def _with_found(table: DataFrame, totals: DataFrame) -> DataFrame:
    found = totals.groupBy(F.col("chunk").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("size", "range", "n", "more"))).alias("found"))
    return table.join(found, F.col("chunk") == F.col("of")).drop("of")


def _found(r: dict, size: int, key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corpus-wide counts of a chunk's n-grams, and whether other chunks hold them, too."""
    parts = [_unpack(f["more"], f["n"], np.int64) for f in r["found"] if f["size"] == size]
    more = np.empty(len(key), np.int64)
    more[np.argsort(key, kind="stable")] = np.concatenate(parts) if parts else 0
    return own + (more >> 1), (more & 1).astype(bool)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows whose crc32(id as text) mod ``mod`` isn't ``rest``. A null text
    counts as the empty one (one token, its end), a null id as an empty text. Repeated rows are
    learned from and scored one by one. Without training rows every probability is 1. Tasks hold one chunk of texts or one
    longer text as numbers; other columns are ignored, an empty table gives none.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       held_out(F.col(id_col), mod, rest).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    table = chunks(docs)
    n_tokens, tokens_, texts = (int(x or 0) for x in table.agg(F.sum("n_tokens"), F.sum("learned"), F.sum("texts")).first())
    ranges = -(-n_tokens // RANGE) or 1
    short = written(_totals(_over_chunks(table, _GRAMS, lambda r: _short_grams(r, ranges))), "lm-totals")
    kinds = int(short.where("size = 1").agg(F.sum("distinct")).first()[0] or 0)
    long = _totals(_over_chunks(_with_found(table, short.where("size = 2")), _GRAMS, lambda r: _trigrams(r, ranges)))

    def score(r: dict) -> Iterator[dict]:
        c = _chunk(r)
        c.bigrams()
        c.trigrams()
        (total1, _), (total2, shared2) = _found(r, 1, c.words, c.n1), _found(r, 2, c.key2, c.n2)
        ask, total3 = c.asked(shared2), c.n3.copy()
        total3[ask] = _found(r, 3, c.key3[ask], c.n3[ask])[0]
        n_known, base, full = c.score(total1, total2, total3, tokens_, kinds, texts)
        yield {"doc_id": r["doc_id"], "held_out": r["held"].astype(bool), "n_tokens": c.sizes,
               "n_known": n_known, "base_score": base, "score": full}

    return _over_chunks(_with_found(table, short.union(long)), _SCORES, score).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens_).cast("long").alias("train_tokens"), "base_score", "score")
