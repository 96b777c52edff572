"""SentencePiece (BPE with byte fallback) encoding and decoding by a max-plus scan.

A sequence of pieces is the model's encoding of a text exactly if each two neighbours are the encoding of
their joint string, so encoding is a best path problem: states are the pieces that end at or reach
over a position, an arc weighs 0 if the next piece is compatible with the last one and minus infinity if
not. In max-plus algebra a chunk of text is a matrix from the states at its left cut to those at its
right cut, and matrices combine associatively:

* giant texts are cut into chunks anywhere; each chunk yields its boundary-state matrix in a task
  of its own; a scan over the matrices of a text gives the state at every cut; with both its
  states known, every chunk is backtraced on its own;
* no piece holds certain pairs of neighbouring characters (a word's end and the next space, say). Between
  such a pair every path goes through one state, so the text falls into units, and the encoding of a
  unit is remembered.
"""

from __future__ import annotations

import hashlib
import re
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotbank.llm.common import map_rows, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Texts of more characters are encoded in chunks of ``CHUNK`` characters.
GIANT = 1 << 16
CHUNK = 1 << 14
#: Longer units are encoded by the best path, whose time is linear.
UNIT = 64
#: Units that a worker remembers, at most.
REMEMBER = 50_000
#: Units that are encoded at a time, at most; fewer than ``FEW`` one by one.
BATCH = 1 << 12
FEW = 64
#: Bytes of rows that a worker has in hand at a time.
SLICE = 1 << 20

State = tuple[int, int]  # a piece from a to b; (0, 0) before the first


class Vocabulary:
    """Pieces and scores of a model file; the lattice over a text."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.pieces, self.kinds = pieces, kinds
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "piece"}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.loss = {p: -x for p, x in self.score.items()}
        self.packed = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        self.no_piece = float("inf")
        self.unknown = kinds.index("unknown")
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        self.longest = max(map(len, self.ids), default=1)
        sizes: dict[str, set] = {}
        for p in self.ids:
            sizes.setdefault(p[-1], set()).add(len(p))
        self.sizes = {c: tuple(sorted(s | {1}, reverse=True)) for c, s in sizes.items()}
        self.pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.unit = self._unit_pattern()
        self.fits: dict = {}
        self.units = _Units(self)

    def _unit_pattern(self) -> re.Pattern:
        """Pieces of text between places that no piece reaches over: before a space that follows something
        else, around line ends, and after a run of letters. Only what holds in this vocabulary is used."""
        if any("\n" in p for p in self.ids) or any(a != SPACE and b == SPACE for a, b in self.pairs):
            return re.compile("(?s).+")
        letter = re.compile(r"[^\W\d_]")
        letters = {c for p in self.ids for c in p if letter.match(c)}
        joined: set[str] = set()  # letters that some piece joins with a following other character
        while more := {a for a, b in self.pairs if a in letters - joined and b not in letters - joined}:
            joined |= more
        not_joined = "".join(map(re.escape, sorted(joined)))
        run = rf"[^\W\d_{not_joined}]"
        return re.compile(rf"\n|{SPACE}*{run}+|{SPACE}*(?:(?!{run})[^{SPACE}\n])(?:[^{SPACE}\n])*|{SPACE}+")

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: ("byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else
                          "piece" if not (m.is_control(i) or m.is_unused(i)) else "control")
        n = len(m)
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], [kind(i) for i in range(n)])

    def __reduce__(self):
        return Vocabulary, (self.pieces, [self.score.get(p, 0.0) for p in self.pieces], self.kinds)

    def merged(self, s: str) -> list[str]:
        """The encoding of a short string by its definition: join the neighbours with the best score, the
        first of them, until no two make a piece."""
        parts = list(s)
        get, none = self.loss.get, self.no_piece
        loss = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while loss:
            least = min(loss)
            if least == none:
                break
            i = loss.index(least)
            parts[i] = piece = parts[i] + parts.pop(i + 1)
            del loss[i]
            if i:
                loss[i - 1] = get(parts[i - 1] + piece, none)
            if i < len(loss):
                loss[i] = get(piece + parts[i + 1], none)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether both stay as they are side by side (an empty ``left``: at a unit's start)."""
        key = (left, right)
        out = self.fits.get(key)
        if out is None:
            if len(self.fits) > 4 * REMEMBER:
                self.fits.clear()
            out = self.fits[key] = (self.merged(left + right) == ([left, right] if left else [right]))
        return out

    def walk(self, text: str, entry: State, to: int) -> dict[int, int]:
        """From the entry piece on: for each reachable end, the start of the one piece that ends there."""
        last = {entry[1]: entry[0]}
        ids, sizes, fits, compatible, one = self.ids, self.sizes, self.fits, self.compatible, (1,)
        for e in range(entry[1] + 1, to + 1):
            for n in sizes.get(text[e - 1], one):
                b = e - n
                if b in last:
                    piece = text[b:e]
                    if n == 1 or piece in ids:
                        left = text[last[b]:b]
                        ok = fits.get((left, piece))
                        if ok or ok is None and compatible(left, piece):
                            last[e] = b
                            break
        return last

    @staticmethod
    def back(last: dict[int, int], e: int, stop: int) -> list[tuple[int, int]]:
        out = []
        while e > stop:
            out.append((last[e], e))
            e = last[e]
        return out[::-1]

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if len(self.byte) == 256:
            return [self.byte[b] for b in piece.encode("utf-8", "replace")]
        return [self.unknown]

    def encode_unit(self, unit: str) -> bytes:
        """Ids of a unit. All paths meet at both its ends, so it is encoded alone: a short one by the
        definition, a long one by the best path."""
        if len(unit) <= UNIT:
            parts = self.merged(unit)
            try:
                return b"".join(map(self.packed.__getitem__, parts))
            except KeyError:  # a character that is no piece
                return np.array([i for p in parts for i in self.ids_of(p)], np.int32).tobytes()
        last = self.walk(unit, (0, 0), len(unit))
        return np.array([i for a, b in self.back(last, len(unit), 0) for i in self.ids_of(unit[a:b])], np.int32).tobytes()

    @cached_property
    def joins(self) -> _Joins:
        return _Joins(self.ids, self.loss)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit: of short ones together, if they have no other characters than pieces."""
        if len(units) < FEW:
            return list(map(self.encode_unit, units))
        return [self.encode_unit(u) if x is None else x for u, x in zip(units, self.joins.encode(units))]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts (see :func:`normal`)."""
        parts = [list(map(self.units.__getitem__, self.unit.findall(t))) for t in texts]
        self.units.fill()
        return [np.frombuffer(b"".join(p), np.int32) for p in parts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    # --- chunks -------------------------------------------------------------------------------------

    def cuts(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and the last place in [a, b] between two characters that no piece joins."""
        def hard(i: int) -> bool:
            return 0 < i < len(text) and text[i - 1:i + 1] not in self.pairs

        first = next((i for i in range(a, b + 1) if hard(i)), None)
        return None if first is None else (first, next(i for i in range(b, a - 1, -1) if hard(i)))

    def states_at(self, text: str, cut: int) -> list[State]:
        """Pieces that start before ``cut`` and end at or after it."""
        if cut == 0:
            return [(0, 0)]
        return [(a, b) for a in range(max(0, cut - self.longest), cut)
                for b in range(cut, min(len(text), a + self.longest) + 1)
                if b - a == 1 or text[a:b] in self.ids and self.compatible("", text[a:b])]

    def _exits(self, text: str, last: dict[int, int], right: int, final: bool) -> list[State]:
        ends = [right] if final else range(right, min(len(text), right + self.longest) + 1)
        return [(last[e], e) for e in ends if e in last and last[e] < right]

    def matrix(self, text: str, left: int, right: int, final: bool) -> dict[tuple[State, State], float]:
        """Weights from the states at cut ``left`` to those at ``right`` (sparse: minus infinity is left out).
        ``text`` is the chunk with its surroundings."""
        found = self.cuts(text, left, right)
        ahead = right if final else min(len(text), right + self.longest)
        out: dict = {}
        tail = None
        if found:
            tail = self._exits(text, self.walk(text, (found[1], found[1]), ahead), right, final)
        for s in self.states_at(text, left):
            if tail is None or s[1] > found[0]:
                ends = self._exits(text, self.walk(text, s, ahead), right, final)
            else:
                ends = tail if found[0] in self.walk(text, s, found[0]) else []
                if found[1] == right:  # the piece that ends at the cut is known only from before it
                    ends = self._before(text, s, found[0], found[1], right, final, ahead)
            for t in ends:
                out[s, t] = 0.0
        return out

    def _before(self, text, s, first, at, right, final, ahead):
        """Exits if the last hard place is the right cut itself: walk on from the hard place before it."""
        if first not in self.walk(text, s, first):
            return []
        if first == at:
            return self._exits(text, self.walk(text, s, ahead), right, final)
        prior = self.cuts(text, first, at - 1)
        start = prior[1] if prior else first
        return self._exits(text, self.walk(text, (start, start), ahead), right, final)

    def backtrace(self, text: str, entry: State, exit_: State) -> list[int]:
        """Ids of the pieces between the two states, the exit's piece included."""
        a, b = entry[1], exit_[1]
        found = self.cuts(text, a, exit_[0]) if a <= exit_[0] else None
        if a >= b:
            return []
        if not found:
            spans = self.back(self.walk(text, entry, b), b, a)
            return [i for x, y in spans for i in self.ids_of(text[x:y])]
        first, last = found
        head = self.back(self.walk(text, entry, first), first, a)
        rest = self.back(self.walk(text, (last, last), b), b, last)
        out = [i for x, y in head for i in self.ids_of(text[x:y])]
        out += self.encode(text[first:last]).tolist()
        return out + [i for x, y in rest for i in self.ids_of(text[x:y])]

    def decode(self, ids: list[int] | pa.Array) -> str:
        """The text of ids: bytes are put together, spaces come back, the added first space goes."""
        if not hasattr(self, "_raw"):
            self._raw = pa.array([bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "piece"
                                  else b" \xe2\x81\x87 " if k == "unknown" else b"" for p, k in zip(self.pieces, self.kinds)],
                                 pa.large_binary())
        ids = ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int32())
        _, ends, data = self._raw.take(ids).buffers()
        raw = data.slice(0, int(np.frombuffer(ends, np.int64)[len(ids)])).to_pybytes() if len(ids) else b""
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class _Joins:
    """The definition of :meth:`Vocabulary.merged` for many units at a time: in each round every unit's two neighbours
    with the best score, the first of them, are joined. Pieces are their ids; a table by hash tells what two make."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, ids: dict[str, int], loss: dict[str, float]):
        chars = [(ord(p), i) for p, i in ids.items() if len(p) == 1]
        self.of_char = np.full(max((c for c, _ in chars), default=0) + 2, -1, np.int64)  # the last: all beyond
        for c, i in chars:
            self.of_char[c] = i
        self.width = max(ids.values(), default=0) + 1
        self.rank = np.zeros(self.width, np.int64)
        if ids:
            self.rank[list(ids.values())] = np.unique([loss[p] for p in ids], return_inverse=True)[1]
        splits = [(ids[p[:k]] * self.width + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p))
                  if p[:k] in ids and p[k:] in ids]
        code, made = np.array(splits, np.int64).reshape(-1, 2).T
        bits = max(4, (4 * len(code)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.code, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at = self._slot(code)
        while len(code):  # a code that finds its slot taken goes to the next
            free = np.flatnonzero(self.code[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.code[at[first]], self.made[at[first]] = code[first], made[first]
            rest = np.setdiff1d(np.arange(len(code)), first)
            code, made, at = code[rest], made[rest], (at[rest] + 1) & self.mask

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two make, or -1."""
        code = left * self.width + right
        at = self._slot(code)
        found = self.code[at]
        out = np.where(found == code, self.made[at], -1)
        go = np.flatnonzero((found != code) & (found >= 0))
        while len(go):
            at[go] = (at[go] + 1) & self.mask
            found = self.code[at[go]]
            out[go] = np.where(found == code[go], self.made[at[go]], -1)
            go = go[(found != code[go]) & (found >= 0)]
        return out

    def encode(self, units: list[str]) -> list[bytes | None]:
        """Packed ids of each unit; None for long units and those with a character that is no piece."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        piece = self.of_char[np.minimum(chars, len(self.of_char) - 1)]
        unit = np.repeat(np.arange(len(units)), sizes)
        odd = sizes > UNIT
        odd[unit[piece < 0]] = True
        keep = ~odd[unit]
        piece, unit = piece[keep], unit[keep]
        place = np.arange(len(piece))
        made, key = np.full(len(piece), -1, np.int64), np.full(len(piece), self.NONE, np.int64)
        changed = place
        done = []
        while len(piece):
            changed = changed[changed + 1 < len(piece)]
            changed = changed[unit[changed] == unit[changed + 1]]
            made[changed] = m = self.join(piece[changed], piece[changed + 1])
            key[changed] = np.where(m >= 0, (self.rank[m] << 32) | place[changed], self.NONE)
            start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            size = np.diff(np.append(start, len(piece)))
            best = np.minimum.reduceat(key, start)
            live = best < self.NONE
            on = np.repeat(live, size)
            done.append((unit[~on], piece[~on]))
            hit = on & (key == np.repeat(best, size))
            piece[hit] = made[hit]
            on[1:] &= ~hit[:-1]
            # a joined piece may now join either neighbour; as the last of its unit it joins none
            key[hit] = self.NONE
            at = np.flatnonzero(hit[on])
            piece, unit, place, made, key = piece[on], unit[on], place[on], made[on], key[on]
            changed = np.concatenate([at, at[at > 0] - 1])
        unit, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*done)) or ((), ())))
        raw = piece[np.argsort(unit, kind="stable")].astype(np.int32).tobytes()
        ends = 4 * np.cumsum(np.bincount(unit, minlength=len(units)))
        return [None if o else raw[a:b] for o, a, b in zip(odd.tolist(), [0, *ends.tolist()], ends.tolist())]


class _Units(dict):
    """Encodings of units. One that isn't known is an empty place until :meth:`fill` encodes all of them. When full,
    those not asked for since the last time go."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older, self.empty = vocabulary, {}, {}

    def __missing__(self, unit: str) -> bytes | bytearray:
        if len(unit) > UNIT:
            return self.vocabulary.encode_unit(unit)
        if len(self) >= REMEMBER:
            self.fill()
            self.older = dict(self)
            self.clear()
        out = self.older.get(unit)
        if out is None:
            if len(self.empty) >= BATCH:
                self.fill()
            out = self.empty[unit] = bytearray()
        self[unit] = out
        return out

    def fill(self) -> None:
        for (unit, place), ids in zip(self.empty.items(), self.vocabulary.encode_units(list(self.empty))):
            place[:] = ids
            self[unit] = ids
        self.empty = {}


def normal(text: str) -> str:
    """A space before the text, and all spaces as the pieces have them; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def product(x: dict, y: dict) -> dict:
    """Max-plus product of two sparse matrices; associative."""
    rows: dict = {}
    for (t, u), w in y.items():
        rows.setdefault(t, []).append((u, w))
    out: dict = {}
    for (s, t), v in x.items():
        for u, w in rows.get(t, ()):
            if v + w > out.get((s, u), float("-inf")):
                out[s, u] = v + w
    return out


def scan(matrices: list[dict]) -> list[tuple[State, State]]:
    """(entry, exit) of each chunk on the best path from the start to the end of the text."""
    start: State = (0, 0)
    before = [{(start, start): 0.0}]
    for m in matrices:
        before.append(product(before[-1], m))
    state = max(before[-1], key=before[-1].get)[1]
    out = []
    for m, reach in zip(matrices[::-1], before[-2::-1]):
        entry = max((s for (s, t) in m if t == state and (start, s) in reach),
                    key=lambda s: reach[start, s] + m[s, state])
        out.append((entry, state))
        state = entry
    return out[::-1]


def _flat(m: dict) -> list[int]:
    return [x for (s, t) in m for x in (*s, *t)]


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text",
           giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text, ids, n_chunks) of every row; the ids are those that the model's library gives.

    Null and empty texts have no ids (a null text stays null). Repeated rows are encoded one by one;
    other columns are ignored. The vocabulary, a file of fixed size, is broadcast; only the chunks
    of giant texts are shuffled.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    large = F.coalesce(F.length("text"), F.lit(0)) > giant

    def small(cols: dict) -> dict:
        v = shared.value
        ids = v.encode_all([normal(t or "") for t in cols["text"].to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        return {"doc_id": cols["doc_id"], "text": cols["text"], "ids": pa.ListArray.from_arrays(offsets, values),
                "n_chunks": [1 if len(x) else 0 for x in ids]}

    schema = "doc_id long, text string, ids array<int>, n_chunks int"
    done = map_rows(rows.where(~large), schema, small, SLICE)
    giants = written(rows.where(large).select(F.monotonically_increasing_id().alias("uid"), "*"), "giants")
    return done.union(_encode_giants(giants, shared, chunk).select("doc_id", "text", "ids", "n_chunks"))


def _encode_giants(giants: DataFrame, shared, chunk: int) -> DataFrame:
    def cut(cols: dict) -> dict:
        around = shared.value.longest + 1
        out = {k: [] for k in ("uid", "i", "at", "left", "right", "final", "part")}
        for uid, text in zip(cols["uid"].to_pylist(), cols["text"].to_pylist()):
            t = normal(text)
            for i, a in enumerate(range(0, len(t), chunk)):
                b = min(len(t), a + chunk)
                at = max(0, a - around)
                for k, x in zip(out, (uid, i, at, a - at, b - at, b == len(t), t[at:b + around])):
                    out[k].append(x)
        return out

    parts = written(map_rows(giants.select("uid", "text"), "uid long, i int, at long, left int, right int, final boolean, "
                             "part string", cut).repartition("uid", "i"), "chunks")

    def transfer(cols: dict) -> dict:
        v, out = shared.value, []
        for at, left, right, final, part in zip(*(cols[c].to_pylist() for c in ("at", "left", "right", "final", "part"))):
            m = v.matrix(part, left, right, final)
            # the first chunk has no piece before it; elsewhere states count from the text's start
            out.append([x + at for x in _flat(m)])
        return {"uid": cols["uid"], "i": cols["i"], "m": out}

    def path(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        mats = [{((m[j], m[j + 1]), (m[j + 2], m[j + 3])): 0.0 for j in range(0, len(m), 4)} for m in rows["m"]]
        states = scan(mats)
        return pd.DataFrame({"u": rows["uid"].to_numpy(), "j": rows["i"].to_numpy(),
                             "states": [[*s, *t] for s, t in states]})

    mats = map_rows(parts, "uid long, i int, m array<long>", transfer, SLICE)
    states = mats.groupBy("uid").applyInPandas(path, "u long, j int, states array<long>")

    def back(cols: dict) -> dict:
        v, out = shared.value, []
        for at, part, s in zip(*(cols[c].to_pylist() for c in ("at", "part", "states"))):
            a, b, c, d = (x - at for x in s)
            out.append(v.backtrace(part, (a, b), (c, d)))
        return {"uid": cols["uid"], "i": cols["i"], "ids": out}

    ids = (map_rows(parts.join(states, (F.col("uid") == F.col("u")) & (F.col("i") == F.col("j")))
                    .select("uid", "i", "at", "part", "states"), "uid long, i int, ids array<int>", back, SLICE)
           .groupBy(F.col("uid").alias("u")).agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("parts")))
    return giants.join(ids, F.col("uid") == F.col("u")).select(
        "doc_id", "text", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.size("parts").alias("n_chunks"))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text, ids, n_chunks, decoded): ``decoded`` is the text that the ids stand for (empty for none)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(cols: dict) -> dict:
        v = shared.value
        return {**{c: cols[c] for c in ("doc_id", "text", "ids", "n_chunks")},
                "decoded": [v.decode(x.values) for x in cols["ids"]]}

    return map_rows(encoded, "doc_id long, text string, ids array<int>, n_chunks int, decoded string", run, SLICE)


def digest(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_chunks, ids_sha256, round_trip); the hash is over the ids as
    little-endian 32-bit integers, ``round_trip`` whether they decode to the text. A null text has 0 characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(cols: dict) -> dict:
        v, out = shared.value, {k: [] for k in ("n_chars", "n_tokens", "ids_sha256", "round_trip")}
        for text, ids in zip(cols["text"], cols["ids"]):
            text, ids = text.as_py() or "", ids.values
            out["n_chars"].append(len(text))
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.to_numpy().astype("<i4", copy=False).tobytes()).hexdigest())
            out["round_trip"].append(v.decode(ids) == text)
        return {"doc_id": cols["doc_id"], "n_chunks": cols["n_chunks"], **out}

    return map_rows(encoded.select("doc_id", "text", "ids", "n_chunks"),
                    "doc_id long, n_chars int, n_tokens int, n_chunks int, ids_sha256 string, round_trip boolean", run, SLICE)
