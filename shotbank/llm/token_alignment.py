"""Alignment of two tokenizers over a corpus: groups between common token ends, and how often ids are linked.

Both tokenizers cut the same bytes. Byte offsets where tokens of both end cut them into groups; tokens of both that
overlap are linked. Most groups of common text are one token of each with the same bytes. An array from each id of A
to the id of B with the same bytes is computed beforehand: links between such ids are counted in a vector as long as
A's vocabulary, which is summed and shipped whatever the corpus. Only the other links, all of them from irregular groups,
are shuffled as pairs: each chunk of texts counts its own first, sends every pair once, and gets back the corpus-wide
count of the pairs it has.

Both tokenizers can be cut at most spaces, so a text is a sequence of units, mostly words. A chunk of texts encodes
and aligns each distinct unit once and keeps the texts as numbers of units; it is written, and read again to look up
the counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shotbank.llm.common import _arrow_schema, written

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text in one chunk, at least (a longer text is a chunk of its own).
CHUNK = 4 << 20
#: Characters of distinct units that are encoded at a time, and their tokens that are aligned.
SLICE = 1 << 18
PIECE = 300_000

# Fixed values of byte-level entries: bytes that stand for themselves; the others follow from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: A place where both tokenizers can be cut: a space after a character that is no white space in either's sense.
_CUT = re.compile(r"(?<=[^\s▁]) (?=.)", re.S)
#: Texts where some space is no such place.
_UNEVEN = re.compile(r"^ |[\s▁] | \Z")


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for."""
    other = [b for b in range(256) if b not in set(_PLAIN)]
    return {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(other)}


def _even(text: str) -> list[str]:
    """Pieces of ``text`` that all start with the space that it starts with or was cut before."""
    at = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
    return [text[x:y] for x, y in zip(at, at[1:])]


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the id of B with the same bytes as each id of A (or -1)."""

    _known: dict[bytes, Vocabularies] = {}

    def __init__(self, raw_a: bytes, raw_b: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(raw_a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        spec = json.loads(raw_a)
        of, added = byte_values(), {t["id"] for t in spec["added_tokens"]}
        entries = {i: bytes(map(of.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if i not in added}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.bytes_b = []
        plain = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.bytes_b.append(piece.replace("▁", " ").encode())
                if not self.b.is_control(i) and not self.b.is_unknown(i):
                    plain[self.bytes_b[-1]] = i
        self.len_a, self.len_b = (np.array([len(x) for x in v]) for v in (self.bytes_a, self.bytes_b))
        self.same = np.array([plain.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        # a cut before a space is only safe where no piece holds one after another character
        self.cuttable = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b)))
        self.dtype_a, self.dtype_b = (np.uint16 if len(v) <= 1 << 16 else np.uint32 for v in (self.bytes_a, self.bytes_b))
        # ids as text with what may follow them, for the hash of the groups
        self.shown = ([f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"]
                      + [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"])

    @classmethod
    def of(cls, files: tuple[bytes, bytes]) -> Vocabularies:
        """One per Python worker."""
        key = hashlib.sha256(files[0] + files[1]).digest()
        if key not in cls._known:
            cls._known[key] = cls(*files)
        return cls._known[key]

    def units(self, text: str) -> list[str]:
        """The text cut where neither tokenizer reaches over; a space, which is left out, is before each unit."""
        if not self.cuttable:
            return [text]
        if _UNEVEN.search(text):
            return [u[1:] for u in _even(" " + text)]
        return text.split(" ")

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, how many per unit, ids of B, how many, whether both give back the unit) of units with the space
        before them. They are encoded as one text and found again by their bytes; if any isn't given back, one by one."""
        text = " ".join(units)
        raw = (" " + text).encode()
        a = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, self.dtype_a)
        b = np.array(self.b.encode(text), self.dtype_b)
        if (b"".join([self.bytes_a[i] for i in a.tolist()]) == raw and b"".join([self.bytes_b[i] for i in b.tolist()]) == raw):
            ends = np.cumsum([len(u.encode()) + 1 for u in units])
            ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
            at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
            if (ends_a[at_a] == ends).all() and (ends_b[at_b] == ends).all():
                return a, np.diff(at_a, prepend=-1), b, np.diff(at_b, prepend=-1), np.ones(len(units), bool)
        if len(units) > 1:
            return tuple(np.concatenate(x) for x in zip(*(self.encode([u]) for u in units)))
        return a, np.array([len(a)]), b, np.array([len(b)]), np.zeros(1, bool)


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Alignment:
    """Groups and links of two id sequences over the same bytes."""

    def __init__(self, v: Vocabularies, a: np.ndarray, b: np.ndarray):
        self.v, self.a, self.b = v, a.astype(np.int64), b.astype(np.int64)
        ends_a, ends_b = np.cumsum(v.len_a[a]), np.cumsum(v.len_b[b])
        #: whether a token ends a group
        self.last_a, self.last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        # what lies between two neighbouring ends is in one token of each: a link
        ends = np.union1d(ends_a, ends_b)
        self.link_a, self.link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(id of A, id of B) per link."""
        return self.a[self.link_a], self.b[self.link_b]

    def texts(self) -> list[str]:
        """The groups as text, a token at a time: ids of A, ids of B, and what follows each."""
        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        n = int(self.last_a.sum())
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n))])
        upto_a = np.cumsum(np.bincount(group_a, minlength=n))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + before_b[group_a]] = 2 * self.a + self.last_a
        codes[np.arange(len(self.b)) + upto_a[group_b]] = 2 * (len(self.v.bytes_a) + self.b) + self.last_b
        return list(map(self.v.shown.__getitem__, codes.tolist()))


def _pieces(sizes: list[int], limit: int) -> Iterator[slice]:
    """Neighbours that have about ``limit`` together."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit or i == len(sizes) - 1:
            yield slice(at, i + 1)
            at, held = i + 1, 0


_CHUNKS = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, "
           "units array<long>, packed array<binary>, sizes array<long>, "
           "same array<int>, same_links array<long>, pair array<long>, pair_links array<long>")


def _counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, back = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(back, np.concatenate(counts), len(code)).astype(np.int64)


def _sums(per_unit: np.ndarray, unit: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Per text the sum over its units; ``units`` are how many each has."""
    return np.diff(np.concatenate([[0], np.cumsum(per_unit[unit])])[np.concatenate([[0], np.cumsum(units)])])


def _no_units(v: Vocabularies) -> tuple:
    none = np.zeros(0, np.int64)
    return none.astype(v.dtype_a), none, none.astype(v.dtype_b), none, none.astype(bool)


def encode_chunk(v: Vocabularies, ids: list, texts: list[str]) -> dict:
    """One row of chunks: its distinct units with their ids, its texts as units, and its own link counts."""
    number = _Numbers()
    of = [np.fromiter(map(number.__getitem__, v.units(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    distinct = list(number)
    # units at whose end a text can't be cut are encoded alone
    odd = np.array([not u or u[-1] == "▁" or u[-1].isspace() for u in distinct], bool)
    by = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    distinct, many = [distinct[i] for i in by], int((~odd).sum())
    parts = [v.encode(distinct[:many][p]) for p in _pieces([len(u) + 1 for u in distinct[:many]], SLICE)]
    parts += [v.encode([u]) for u in distinct[many:]]
    a, unit_a, b, unit_b, right = (np.concatenate(x) for x in zip(*parts)) if parts else _no_units(v)
    place = np.empty(len(by), np.int32)
    place[by] = np.arange(len(by))
    of = [place[u] for u in of]
    # a text with a unit that isn't given back has no tokens at all
    of = [u if right[u].all() else u[:0] for u in of]
    unit, units = np.concatenate([np.zeros(0, np.int32), *of]), np.array([len(u) for u in of], np.int64)
    times = np.bincount(unit, minlength=len(distinct))
    kept = times > 0
    a, b = a[np.repeat(kept, unit_a)], b[np.repeat(kept, unit_b)]
    unit, times, unit_a, unit_b = (np.cumsum(kept) - 1)[unit].astype(np.int32), times[kept], unit_a[kept], unit_b[kept]
    at_a, at_b = np.concatenate([[0], np.cumsum(unit_a)]), np.concatenate([[0], np.cumsum(unit_b)])
    same: tuple[list, list] = ([], [])
    pairs: tuple[list, list] = ([], [])
    groups, shown = np.zeros(len(times), np.int64), []
    for part in _pieces((unit_a + unit_b).tolist(), PIECE):
        al = Alignment(v, a[at_a[part.start]:at_a[part.stop]], b[at_b[part.start]:at_b[part.stop]])
        x, y = al.links()
        ends = np.cumsum(unit_a[part])
        often = times[part][np.searchsorted(ends, al.link_a, "right")]
        plain = v.same[x] == y
        for (codes, counts), got, n in ((same, x[plain], often[plain]), (pairs, (x * len(v.bytes_b) + y)[~plain], often[~plain])):
            codes.append(got)
            counts.append(n)
        groups[part] = np.diff(np.concatenate([[0], np.cumsum(al.last_a)[ends - 1]]))
        text = al.texts()
        at = np.cumsum(unit_a[part] + unit_b[part]).tolist()
        shown += ["".join(text[lo:hi]) for lo, hi in zip([0, *at], at)]
    hashes, at = [], 0
    for n in units.tolist():
        # groups end with a semicolon, the last one of a text without
        hashes.append(hashlib.sha256("".join([shown[u] for u in unit[at:at + n].tolist()])[:-1].encode()).hexdigest() if n else "")
        at += n
    (s, s_n), (p, p_n) = _counted(*same), _counted(*pairs)
    return {"doc_id": ids, "n_a": _sums(unit_a, unit, units), "n_b": _sums(unit_b, unit, units),
            "n_groups": _sums(groups, unit, units), "groups_sha256": hashes, "units": units, **_packed(unit, unit_a.astype(np.int32), unit_b.astype(np.int32), a, b),
            "same": s, "same_links": s_n, "pair": p, "pair_links": p_n}


def _packed(*arrays: np.ndarray) -> dict:
    """Each array, compressed, and its bytes."""
    return {"packed": [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in arrays], "sizes": [x.nbytes for x in arrays]}


def _unpacked(packed: list[bytes], sizes: list[int], v: Vocabularies) -> list[np.ndarray]:
    kinds = (np.int32, np.int32, np.int32, v.dtype_a, v.dtype_b)
    return [np.frombuffer(pa.decompress(x, n, "zstd") if n else b"", t) for x, n, t in zip(packed, sizes, kinds)]


def _files(model_a: str, model_b: str) -> tuple[bytes, bytes]:
    with open(model_a, "rb") as f, open(model_b, "rb") as g:
        return f.read(), g.read()


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """Written table of encoded chunks (see ``_CHUNKS``). The two vocabulary files, of fixed size, are read by the
    driver and broadcast."""
    files = docs.sparkSession.sparkContext.broadcast(_files(model_a, model_b))
    struct = StructType.fromDDL(_CHUNKS)
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies.of(files.value)
        number = TaskContext.get().partitionId() << 32

        def row(ids: list, texts: list[str]) -> pa.RecordBatch:
            out = {"chunk": number, **encode_chunk(v, ids, texts)}
            return pa.RecordBatch.from_arrays([pa.array([out[f.name]], f.type) for f in arrow], schema=arrow)

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py() or ""
                ids.append(i)
                texts.append(text)
                held += len(text) + 100
                if held >= CHUNK:
                    yield row(ids, texts)
                    ids, texts, held = [], [], 0
                    number += 1
        if ids:
            yield row(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, struct), "encoded")


def _pairs(encoded: DataFrame) -> DataFrame:
    return encoded.select("chunk", F.explode(F.arrays_zip("pair", "pair_links")).alias("p")).select(
        "chunk", F.col("p.pair").alias("pair"), F.col("p.pair_links").alias("links"))


def _same(encoded: DataFrame) -> DataFrame:
    return (encoded.select(F.explode(F.arrays_zip("same", "same_links")).alias("p"))
            .groupBy(F.col("p.same").alias("a")).agg(F.sum("p.same_links").alias("links")))


def pair_counts(encoded: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """(a, b, links): the corpus-wide number of links of each pair of ids."""
    v = Vocabularies.of(_files(model_a, model_b))
    width = len(v.bytes_b)
    same = encoded.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(v.same) if b >= 0], "a int, b long")
    other = _pairs(encoded).groupBy("pair").agg(F.sum("links").alias("links"))
    return other.select(F.expr(f"cast(pair div {width} as int)").alias("a"), F.expr(f"pair % {width}").alias("b"), "links").union(
        _same(encoded).join(F.broadcast(same), "a").select("a", "b", "links"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Null and empty texts and those whose tokens don't join to their bytes have zeros and an empty hash. Repeated
    rows are texts of their own and count each. Tasks hold a chunk of texts or one longer text as numbers of units, and
    its distinct units. Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    encoded = chunks(docs, id_col, text_col, model_a, model_b)
    v = Vocabularies.of(_files(model_a, model_b))
    width = len(v.bytes_b)
    total = written(_pairs(encoded).groupBy("pair").agg(F.sum("links").alias("total")), "pair-counts")
    # two vectors as long as the vocabularies
    same, best = np.zeros(len(v.bytes_a), np.int64), np.zeros(width, np.int64)
    for r in _same(encoded).collect():
        same[r["a"]] = r["links"]
    for r in total.groupBy(F.expr(f"pair % {width}").alias("b")).agg(F.max("total").alias("most")).collect():
        best[r["b"]] = r["most"]
    np.maximum.at(best, v.same[v.same >= 0], same[v.same >= 0])
    shared = spark.sparkContext.broadcast((_files(model_a, model_b), same, best))
    found = (_pairs(encoded).select("chunk", F.col("pair").alias("p")).join(total, F.col("p") == F.col("pair"))
             .groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("pair", "total")).alias("found")))
    rows = (encoded.drop("same", "same_links", "pair", "pair_links").join(found, F.col("chunk") == F.col("c"), "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "units", "packed", "sizes",
                    F.col("found.pair").alias("pair"), F.col("found.total").alias("total")))
    names = rows.columns
    struct = StructType.fromDDL("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, same, best = shared.value
        v = Vocabularies.of(files)
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            col = {n: row.column(i) for i, n in enumerate(names)}
            values = {n: c.values if pa.types.is_list(c.type) else c for n, c in col.items()}
            values = {n: c.slice(col[n].offsets[0].as_py(), col[n].offsets[1].as_py() - col[n].offsets[0].as_py())
                      if pa.types.is_list(col[n].type) else c for n, c in values.items()}
            pair, total = (values[n].to_numpy() for n in ("pair", "total"))
            by = np.argsort(pair)
            pair, total = pair[by], total[by]
            unit, n_a, n_b, a, b = _unpacked(values["packed"].to_pylist(), values["sizes"].to_pylist(), v)
            units = values["units"].to_numpy()
            best_of, count_of = np.zeros(len(n_a), np.int64), np.zeros(len(n_a), np.int64)
            at_a, at_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
            for part in _pieces((n_a + n_b).tolist(), PIECE):
                lo, hi = part.start, part.stop
                al = Alignment(v, a[at_a[lo]:at_a[hi]], b[at_b[lo]:at_b[hi]])
                x, y = al.links()
                plain = v.same[x] == y
                count = same[x]
                count[~plain] = total[np.searchsorted(pair, x[~plain] * len(v.bytes_b) + y[~plain])]
                mine = np.searchsorted(at_a[lo + 1:hi + 1] - at_a[lo], al.link_a, "right")
                best_of[part] = np.bincount(mine, count == best[y], hi - lo).astype(np.int64)
                # whole numbers, summed exactly
                count_of[part] = np.diff(np.concatenate([[0], np.cumsum(count)])[np.searchsorted(mine, np.arange(hi - lo + 1))])
            n_best, count_sum = _sums(best_of, unit, units), _sums(count_of, unit, units)
            out = {n: values[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            tokens = (values[n].to_numpy() for n in ("n_a", "n_b", "n_groups"))
            out |= {"n_links": next(tokens) + next(tokens) - next(tokens), "n_best": n_best, "count_sum": count_sum}
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
                                              for f in arrow], schema=arrow)

    return rows.mapInArrow(run, struct)
