"""Similarity join of word shingle sets by chosen paths.

A set is five-word shingles; sets link if their Jaccard similarity is at least 0.8. Each set is embedded as
``BINS`` tokens (the smallest shingle hash of each bin), of which two sets share a share like their
similarity. A run starts with all sets in one bucket; a bucket is split by sampling: every set goes to the child
of each of its tokens whose hash, together with the bucket's path, falls below 1 / (LAMBDA * tokens). Similar sets
sample the same tokens, so a pair at the threshold meets in at least one child on average at each level,
while others part. Buckets that are small, or whose members are alike on average, are compared by brute
force. A set takes part in as many runs as the target recall needs at the greatest depth that one of its buckets
reached: all sets in the first runs, and only those of deep buckets in the rest. Of buckets with the same members one is compared.
All links are verified on the whole shingle sets.

Equal texts are one set. A pair is judged in the bucket with the smallest key that both are in, so
nothing is counted twice; tasks return counts and a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotbank.llm.common import _parts, components, dropped, forest, fresh, map_rows, written

WORDS = 5
MIN_JACCARD = 0.8
BINS = 64
#: Sampling: a set goes to 1 / LAMBDA children on average.
LAMBDA = 0.7
RECALL = 0.999
#: Buckets are split up to this depth, and the runs are enough for pairs at the threshold that must meet there.
MAX_DEPTH = 8
#: Depths for which runs are added: to the last one for sets with a bucket that is split beyond the one before.
WAVES = (2, MAX_DEPTH)
#: Buckets of up to SMALL members, a few tiles, are compared. Larger ones are split, unless their members are alike: mean similarity of ``PROBE`` of them from DENSE on. Where
#: some of the probe (a share of CORE_SHARE) are like one of them, members from CORE on are compared as a bucket of their
#: own, and only those up to APART go on: if two sets have 0.8 in common and one is below CORE, the other is below 0.7,
#: and APART leaves room for two and a half deviations of an estimate.
SMALL = 4096
PROBE = 32
DENSE = 0.5
CORE, CORE_SHARE, APART = 0.5, 0.125, 0.85
#: Pairs are verified if their embeddings agree at least this far (five deviations below the threshold).
CANDIDATE = 0.55
TILE = 1024
#: Groups of up to so many rows are compared many at a time, pair by pair.
LISTED = 256
#: Bytes of shingle sets in a tile, and of the groups that are compared at a time.
TILE_BYTES = 16 << 20
SHIP_ROWS = 500_000

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _C1
    x = x ^ (x >> np.uint64(27))
    x = x * _C2
    return x ^ (x >> np.uint64(31))


def runs_for(recall: float = RECALL, depth: int = MAX_DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, if it must meet at ``depth``."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


def shingles(text: str | None, memo: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of each five words (lower case, cut at white space); a shorter text is one
    shingle, a text without words none."""
    words = (text or "").lower().split()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    k = min(WORDS, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out + h[i:len(h) - k + 1 + i]) * _ODD
    return np.unique(mix(out))


def embed(s: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin, cut to 32 bits; 0 for an empty bin."""
    out = np.zeros(BINS, np.uint32)
    b = (s >> np.uint64(58)).astype(np.int64)  # s is sorted, so a bin's smallest comes first
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(s) else np.zeros(0, np.int64)
    out[b[first]] = np.maximum((s[first] >> np.uint64(26)) & np.uint64(0xFFFFFFFF), 1)
    return out


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of bins, of those that either has, in which two embeddings agree (all rows against all)."""
    same = np.zeros((len(x), len(y)), np.float32)
    some = np.zeros_like(same)
    for b in range(BINS):
        p, q = x[:, b][:, None], y[:, b][None]
        used = (p > 0) | (q > 0)
        some += used
        same += (p == q) & used
    return same / np.maximum(some, 1)


def children(keys: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): the children of bucket ``keys[row]`` that the set of that row goes to."""
    bins = np.arange(BINS, dtype=np.uint64) << np.uint64(32)
    tokens = mix(bins | sketches.astype(np.uint64))
    used = sketches > 0
    h = mix(tokens ^ keys.view(np.uint64)[:, None])
    share = 1 / (LAMBDA * np.maximum(used.sum(1), 1))
    chosen = used & ((h < (np.minimum(share, 0.999) * 2.0 ** 64).astype(np.uint64)[:, None]) | (share >= 1)[:, None])
    row, b = np.nonzero(chosen)
    return row, mix(h[row, b] * _ODD + np.uint64(1)).view(np.int64)


def _sketches(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint32).reshape(-1, BINS)


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each row with the hashes of its text, and one row (cid, rep, n, size, sk) per
    distinct text that has words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"),
                        F.xxhash64(F.lit("second"), text).alias("h2"), text.alias("text"))
    memo = _Hashes()

    def run(cols: dict) -> dict:
        size, sk = [], []
        for t in cols["text"].to_pylist():
            s = shingles(t, memo)
            size.append(len(s))
            sk.append(embed(s).tobytes() if len(s) else None)
        return {"doc_id": cols["doc_id"], "h1": cols["h1"], "h2": cols["h2"], "size": size, "sk": sk}

    rows = written(map_rows(keyed, "doc_id long, h1 long, h2 long, size int, sk binary", run), "sets")
    classes = (rows.where("size > 0").groupBy("h1", "h2")
               .agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sk").alias("sk")))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    return rows.drop("sk"), classes


DONE, CHILD, SPLIT = 0, 1, 2


def _split(depth_counts: bool):
    """Rows (kind, key, cid) from members of large buckets with their bucket's head: members of buckets to be compared,
    children, and with ``depth_counts`` the sets that were split."""

    def run(cols: dict) -> dict:
        key, cid = cols["key"].to_numpy(), cols["cid"].to_numpy()
        sk = _sketches(cols["sk"].to_pylist())
        dense = cols["dense"].to_numpy(zero_copy_only=False).astype(bool)
        heads = cols["head"].to_pylist()
        like = np.zeros(len(key))
        some = np.flatnonzero([h is not None for h in heads])
        if len(some):
            x, y = sk[some], _sketches([heads[i] for i in some])
            used = (x > 0) | (y > 0)
            like[some] = ((x == y) & used).sum(1) / np.maximum(used.sum(1), 1)
        core = ~dense & (like >= CORE)
        further = np.flatnonzero(~dense & (like < APART))
        row, child = children(key[further], sk[further])
        parts = [(DONE, key[dense], cid[dense]), (DONE, mix(key[core].view(np.uint64) ^ _ODD).view(np.int64), cid[core]),
                 (CHILD, child, cid[further][row])]
        if depth_counts:
            parts.append((SPLIT, np.zeros(len(further), np.int64), cid[further]))
        return {"kind": pa.array(np.repeat([k for k, _, _ in parts], [len(c) for _, _, c in parts]), pa.int32()),
                "key": pa.array(np.concatenate([k for _, k, _ in parts])), "cid": pa.array(np.concatenate([c for _, _, c in parts]))}

    return run


def _start(seeds: list[int]):
    """Children of the roots of all runs."""

    def run(cols: dict) -> dict:
        sk = _sketches(cols["sk"].to_pylist())
        got = [children(np.full(len(sk), s, np.int64), sk) for s in seeds]
        return {"key": pa.array(np.concatenate([c for _, c in got])),
                "cid": cols["cid"].take(pa.array(np.concatenate([r for r, _ in got])))}

    return run


def _head(rows: pd.DataFrame) -> pd.DataFrame:
    """Whether a probe's members are alike, else the one that most of the others are like, if enough are."""
    x = _sketches(rows["sk"])
    a = alike(x, x)
    n = len(x)
    dense = (a.sum() - n) / max(1, n * (n - 1)) >= DENSE
    near = (a >= (CORE + 1) / 2).sum(1)
    best = int(near.argmax())
    head = rows["sk"].iloc[best] if not dense and near[best] >= max(2, CORE_SHARE * n) else None
    return pd.DataFrame({"k": rows["key"].iloc[:1], "dense": [bool(dense)], "head": [head]})


def buckets(classes: DataFrame, runs: int | None = None) -> DataFrame:
    """Written (key, cid): the members of all buckets to be compared, each with two members or more.

    ``runs``, when given, is the number of runs of all sets."""
    waves = [(runs, None)] if runs else [(runs_for(depth=d), d) for d in WAVES]
    active, done, before, deep = classes, [], 0, []
    for upto, depth in waves:
        members, split = _run(active, classes, range(before + 1, upto + 1))
        done.append(members)
        deep.append(split)
        before = upto
        # sets whose buckets were split beyond this depth, in these runs or earlier ones
        beyond = [t for s in deep for d, t in s.items() if depth and d >= depth]
        if depth in (None, MAX_DEPTH) or not beyond:
            break
        ids = beyond[0]
        for t in beyond[1:]:
            ids = ids.union(t)
        active = written(classes.join(ids.distinct(), F.col("cid") == F.col("s"), "left_semi"), "active")
    members = done[0]
    for m in done[1:]:
        members = members.union(m)
    members = written(members.distinct(), "all-members")
    # similar sets meet again and again: of buckets with the same members one is enough
    same = (members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("x1"),
                                       F.bit_xor(F.xxhash64(F.lit("second"), "cid")).alias("x2"))
            .groupBy("n", "x1", "x2").agg(F.min("key").alias("k")).select("k"))
    once = written(members.join(written(same, "once"), F.col("key") == F.col("k"), "left_semi"), "members")
    dropped(members, *done)
    return once


def _run(active: DataFrame, classes: DataFrame, runs: range) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(members of the buckets to be compared, sets by the depth at which a bucket of theirs was split further)."""
    sk = classes.select(F.col("cid").alias("c"), "sk")
    seeds = mix(np.array(runs, np.uint64) * _ODD).view(np.int64).tolist()
    rows, done, split, used = map_rows(active.select("cid", "sk"), "key long, cid long", _start(seeds)), [], {}, []
    for depth in range(1, MAX_DEPTH + 1):
        # written before it is joined with its rows, so that Spark can split a hot bucket
        if depth == 1:
            rows = written(rows, "paths")
            used.append(rows)
        sizes = written(rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("k"), "count"), "sizes")
        shared = written(rows.join(sizes, F.col("key") == F.col("k")).select("key", "cid", "count"), "buckets")
        used += [sizes, shared]
        if depth == MAX_DEPTH:
            done.append(shared.select("key", "cid"))
            break
        large = shared.where(F.col("count") > SMALL).select("key", "cid")
        done.append(shared.where(F.col("count") <= SMALL).select("key", "cid"))
        if large.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("cid"), "cid"))
        probe = (large.withColumn("place", place).where(F.col("place") <= PROBE)
                 .join(sk, F.col("cid") == F.col("c")).select("key", "sk"))
        heads = written(probe.groupBy("key").applyInPandas(_head, "k long, dense boolean, head binary"), "heads")
        members = large.join(heads, F.col("key") == F.col("k")).join(sk, F.col("cid") == F.col("c"))
        paths = written(map_rows(members.select("key", "cid", "sk", "dense", "head"), "kind int, key long, cid long",
                                 _split(depth in WAVES)), "paths")
        used += [heads, paths]
        done.append(paths.where(F.col("kind") == DONE).select("key", "cid"))
        rows = paths.where(F.col("kind") == CHILD).select("key", "cid")
        if depth in WAVES:
            split[depth] = written(paths.where(F.col("kind") == SPLIT).select(F.col("cid").alias("s")).distinct(), "split")
    members = done[0]
    for d in done[1:]:
        members = members.union(d)
    members = written(members, "members")
    dropped(*used)
    return members, split


def over_groups(df: DataFrame, group: list[str], schema: str, fn, rows: int = 20_000, size: int = 2 * TILE_BYTES) -> DataFrame:
    """``fn(frame, starts) -> frame`` over whole groups, many small ones at a time.

    Groups are dealt and sorted by Spark; a call gets groups of about ``rows`` rows or ``size`` bytes together, each
    one contiguous from its place in ``starts`` on. No group may be larger than memory: they are tiles."""
    from pyspark.sql.types import StructType

    from shotbank.llm.common import _arrow_schema, in_batches

    struct = StructType.fromDDL(schema)
    out_schema, names = _arrow_schema(struct), df.columns

    def run(batches):
        held: list = []
        count = weight = 0
        for batch in (part for b in batches for part in _parts(b, size // 2)):
            held.append(batch)
            count += batch.num_rows
            weight += batch.nbytes
            if count >= rows or weight >= size:
                frame = pa.Table.from_batches(held).combine_chunks()
                cut = _last_start(frame, group)
                if cut:
                    yield from _call(frame.slice(0, cut))
                    held = frame.slice(cut).combine_chunks().to_batches()
                    count -= cut
                    weight = sum(x.nbytes for x in held)
        if count:
            yield from _call(pa.Table.from_batches(held).combine_chunks())

    def _call(frame: pa.Table):
        got = fn(frame.to_pandas(), _starts(frame, group))
        yield from pa.Table.from_pandas(got, schema=out_schema, preserve_index=False).to_batches()

    return in_batches(df.repartition(*group).sortWithinPartitions(*group).select(*names), run, struct)


def _starts(frame: pa.Table, group: list[str]) -> np.ndarray:
    new = np.zeros(frame.num_rows, bool)
    new[0] = True
    for g in group:
        v = frame.column(g).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _last_start(frame: pa.Table, group: list[str]) -> int:
    return int(_starts(frame, group)[-1])


def _meets(x: list, y: list, key: int) -> bool:
    """Whether ``key`` is the smallest bucket that two members share (their buckets are sorted)."""
    i = j = 0
    while x[i] != y[j]:
        if x[i] < y[j]:
            i += 1
        else:
            j += 1
    return x[i] == key


def _owned(x_keys, y_keys, key: int) -> np.ndarray:
    """All pairs of two tiles, whether ``key`` is the smallest bucket that they share."""
    out = np.ones((len(x_keys), len(y_keys)), bool)
    at: dict[int, tuple[list, list]] = {}
    for side, all_keys in enumerate((x_keys, y_keys)):
        for i, ks in enumerate(all_keys):
            for k in ks:
                if k >= key:
                    break  # sorted
                at.setdefault(k, ([], []))[side].append(i)
    for i, j in at.values():
        if i and j:
            out[np.ix_(i, j)] = False
    return out


def candidate_pairs(f: pd.DataFrame, starts: np.ndarray, min_jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) of the pairs that are worth verifying in their group: sizes allow the similarity,
    the embeddings agree far enough, and the pair belongs to this bucket."""
    size, key, keys = f["size"].to_numpy(), f["key"].to_numpy(), f["keys"].to_list()
    t, t1, t2 = f["t"].to_numpy(), f["t1"].to_numpy(), f["t2"].to_numpy()
    sk = _sketches(f["sk"])
    ends = np.append(starts[1:], len(f))
    out_p, out_q = [], []
    small = (ends - starts) <= LISTED
    # all pairs of all small groups at once: each row with those after it in its group
    after = np.zeros(len(f), np.int64)
    for a, b in zip(starts[small], ends[small]):
        after[a:b] = np.arange(b - a)[::-1]
    p = np.repeat(np.arange(len(f)), after)
    q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(after) - after, after)
    # of two tiles, only pairs across; of one, all
    ok = ((t1[p] == t2[p]) | (t[p] != t[q])) & (np.minimum(size[p], size[q]) >= min_jaccard * np.maximum(size[p], size[q]))
    p, q = p[ok], q[ok]
    for lo in range(0, len(p), 1 << 17):
        x, y = sk[p[lo:lo + (1 << 17)]], sk[q[lo:lo + (1 << 17)]]
        used = (x > 0) | (y > 0)
        near = ((x == y) & used).sum(1) >= CANDIDATE * used.sum(1)
        i, j = p[lo:lo + (1 << 17)][near], q[lo:lo + (1 << 17)][near]
        mine = np.array([_meets(keys[a], keys[b], k) for a, b, k in zip(i, j, key[i])], bool)
        out_p.append(i[mine])
        out_q.append(j[mine])
    for a, b in zip(starts[~small], ends[~small]):
        one = t1[a] == t2[a]
        left = a + np.flatnonzero(t[a:b] == t1[a])
        right = left if one else a + np.flatnonzero(t[a:b] == t2[a])
        x, y = size[left], size[right]
        good = np.minimum(x[:, None], y[None]) >= min_jaccard * np.maximum(x[:, None], y[None])
        good &= _owned([keys[i] for i in left], [keys[i] for i in right], int(key[a]))
        good = np.triu(good, 1) if one else good
        if good.any():
            good &= alike(sk[left], sk[right]) >= CANDIDATE
        i, j = np.nonzero(good)
        out_p.append(left[i])
        out_q.append(right[j])
    return np.concatenate(out_p or [np.zeros(0, np.int64)]), np.concatenate(out_q or [np.zeros(0, np.int64)])


def _candidates(min_jaccard: float):
    """Members with a pair that is worth verifying."""

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        p, q = candidate_pairs(f, starts, min_jaccard)
        return f.iloc[np.unique(np.concatenate([p, q]))]

    return run


def shared_counts(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (p, q) of sets of one group."""
    if len(p) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], True)) for i, j in zip(p, q)], np.int64)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    keep = often[back]
    who, back = who[keep], (np.cumsum(often) - 1)[back[keep]]
    order = np.argsort(back, kind="stable")
    who, back = who[order], back[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(back, [a, a + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[who[lo:hi], back[lo:hi] - a] = 1
        both += m @ m.T
    return np.rint(both[p, q]).astype(np.int64)


def _verify(min_jaccard: float):
    """Per member and group: how many rows it links with here, and the member its links lead it to."""

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        p, q = candidate_pairs(f, starts, min_jaccard)
        group = np.searchsorted(starts, p, "right") - 1
        order = np.argsort(group, kind="stable")
        p, q, group = p[order], q[order], group[order]
        cid, n, size = f["cid"].to_numpy(), f["n"].to_numpy(), f["size"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in f["set"]]
        ends = np.append(starts[1:], len(f))
        both = np.zeros(len(p), np.int64)
        for g in np.unique(group):
            lo, hi = np.searchsorted(group, [g, g + 1])
            a, b = starts[g], ends[g]
            both[lo:hi] = shared_counts(sets[a:b], p[lo:hi] - a, q[lo:hi] - a)
        linked = both >= min_jaccard * (size[p] + size[q] - both) - 1e-9
        p, q = p[linked], q[linked]
        links = np.zeros(len(f), np.int64)
        np.add.at(links, p, n[q])
        np.add.at(links, q, n[p])
        low = forest(cid, p, q)
        some = links > 0
        return pd.DataFrame({"cid": cid[some], "links": links[some], "low": cid[low[some]]})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_jaccard: float = MIN_JACCARD,
                    runs: int | None = None, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, n_links, kept, h1, h2) of every row: the smallest doc_id reachable over links, the
    number of other rows linked directly, whether the row is its class's first, and two hashes of its text.

    Null texts and texts without words link with nothing. Rows with equal texts are linked, repeated rows
    too. A null doc_id is never a class id unless all ids of a class are null. Other columns are ignored.
    """
    rows, classes = sets_of(docs, id_col, text_col)
    members = buckets(classes, runs)
    keys = members.groupBy(F.col("cid").alias("i")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    info = classes.select(F.col("cid").alias("c"), "n", "size", "sk").join(keys, F.col("c") == F.col("i")).drop("i")
    sizes = members.join(classes.select(F.col("cid").alias("c"), "size"), F.col("cid") == F.col("c"))
    by_rows, by_bytes = F.ceil(F.count("*") / tile), F.ceil(F.sum("size") * 8 / TILE_BYTES)
    tiles = written(sizes.groupBy(F.col("key").alias("k")).agg(F.greatest(by_rows, by_bytes).cast("int").alias("tiles")), "tiles")
    tiled = (members.join(tiles, F.col("key") == F.col("k"))
             .select("key", "cid", "tiles", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int").alias("t"))
             .select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
             .select("key", "cid", "t", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"))
             .join(info, F.col("cid") == F.col("c")).drop("c"))
    group = ["key", "t1", "t2"]
    schema = ("key long, cid long, t int, t1 int, t2 int, n long, size int, sk binary, keys array<long>")
    worth = written(over_groups(tiled, group, schema, _candidates(min_jaccard)), "worth")
    sets = _whole_sets(docs, id_col, text_col, classes, worth.select(F.col("cid").alias("c")).distinct())
    found = written(over_groups(worth.join(sets, F.col("cid") == F.col("c")).drop("c"), group,
                                "cid long, links long, low long", _verify(min_jaccard)), "links")
    dropped(members, tiles, worth)
    links = found.groupBy(F.col("cid").alias("l")).agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("low").alias("b")))
    first = (comp.join(classes.select("cid", "rep"), F.col("node") == F.col("cid"))
             .groupBy("component").agg(F.min("rep").alias("class_id")))
    known = (classes.select("cid", F.col("h1").alias("g1"), F.col("h2").alias("g2"), "rep", "n")
             .join(links, F.col("cid") == F.col("l"), "left")
             .join(comp.join(first, "component").select("node", "class_id"), F.col("cid") == F.col("node"), "left")
             .select("g1", "g2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("class_id", "rep").alias("class_id")))
    own = F.coalesce("class_id", "doc_id")
    return (rows.join(known, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
            .select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.col("doc_id").eqNullSafe(own).alias("kept"), "h1", "h2"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their class; of rows that agree in id and
    text one stays."""
    found = near_duplicates(docs, id_col, text_col, **options).where("kept")
    known = [fresh(docs, n) for n in ("first_id", "first_h1", "first_h2", "first_n")]
    first = written(found.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n")).toDF(*known), "first")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.join(first, F.col(id_col).cast("long").eqNullSafe(F.col(known[0])) & (F.xxhash64(text) == F.col(known[1]))
                     & (F.xxhash64(F.lit("second"), text) == F.col(known[2])))
    once = rows.where(F.col(known[3]) == 1)
    if not first.where(F.col(known[3]) > 1).isEmpty():
        once = once.union(rows.where(F.col(known[3]) > 1).dropDuplicates(known))
    return once.select(*docs.columns)


def _whole_sets(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """(c, set): the whole shingle set of each class needed, from one of its texts."""
    want = written(classes.join(needed, F.col("cid") == F.col("c")).select("c", "rep", "h1", "h2"), "needed")
    ship = F.broadcast(want) if want.count() <= SHIP_ROWS else want
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    memo = _Hashes()

    def run(cols: dict) -> dict:
        return {"c": cols["c"], "set": [shingles(t, memo).tobytes() for t in cols["text"].to_pylist()]}

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("x1"),
                        F.xxhash64(F.lit("second"), text).alias("x2"), text.alias("text"))
    texts = keyed.join(ship, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("x1") == F.col("h1")) & (F.col("x2") == F.col("h2")))
    return map_rows(texts.select("c", "text"), "c long, set binary", run).dropDuplicates(["c"])
