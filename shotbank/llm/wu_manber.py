"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items. All windows of a searcher have the same
length m. A block is ``BLOCK`` consecutive words; the shift table gives, for the block that ends
at the cursor, how far the cursor may jump without passing an occurrence (m - BLOCK + 1 for a block
that no window holds, so most of a text is never looked at). A shift of zero looks up the bucket of
that suffix block, picks by the prefix block, and compares the windows word by word.
"""

from __future__ import annotations

import hashlib
import pickle
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotbank.llm.common import keep_rows, map_rows

WINDOW = 13
#: Bytes of benchmark text in one broadcast searcher; a task holds one of them at a time.
BLOCK_BYTES = 16 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased; digits, a-z and everything beyond ASCII."""
    return [] if not text else WORD.findall(text.encode("utf-8", "replace").lower())


class Searcher:
    """Windows of one length, with their items."""

    def __init__(self, windows: dict[tuple, set], m: int):
        self.m, self.block = m, min(2, m)
        b = self.block
        self.default = m - b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for w, items in windows.items():
            for end in range(b, m + 1):
                key = w[end - b:end]
                s = m - end
                if s < self.shift.get(key, self.default):
                    self.shift[key] = s
            self.buckets.setdefault(w[m - b:], {}).setdefault(w[:b], []).append((list(w), items))

    def search(self, words: list[bytes]):
        """Yield (start, items) of every occurrence."""
        m, b, n = self.m, self.block, len(words)
        shift, default, buckets = self.shift.get, self.default, self.buckets
        end = m
        while end <= n:
            key = tuple(words[end - b:end])
            step = shift(key, default)
            if step:
                end += step
                continue
            start = end - m
            for w, items in buckets[key].get(tuple(words[start:start + b]), ()):
                if words[start:end] == w:
                    yield start, items
            end += 1


def build(items: list[tuple]) -> list[Searcher]:
    """Searchers, one for each window length, from (item_id, text)."""
    by_len: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        ws = words_of(text)
        m = min(WINDOW, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            by_len.setdefault(m, {}).setdefault(tuple(ws[i:i + m]), set()).add(item)
    return [Searcher(w, m) for m, w in sorted(by_len.items())]


def scan(searchers: list[Searcher], words: list[bytes]) -> tuple[list[int], set]:
    """Merged [start, end) runs of hit words, flat, and the items found."""
    found, items = [], set()
    for s in searchers:
        for start, its in s.search(words):
            found.append((start, start + s.m))
            items |= its
    return merge(found), items


def merge(found: list[tuple[int, int]]) -> list[int]:
    runs: list[int] = []
    for a, b in sorted(found):
        if runs and a <= runs[-1]:
            runs[-1] = max(runs[-1], b)
        else:
            runs += [a, b]
    return runs


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark in blocks of at most ``block_bytes`` of text (an item is never split)."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        n = len(text or "") * 4
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


def ship(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> list:
    """Searchers of the benchmark as broadcasts, each of at most ``block_bytes`` of benchmark text."""
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(pickle.dumps(build(b))) for b in item_blocks(benchmark, item_col, item_text, block_bytes)]


def _scanner(shared: list):
    """A function from texts to [(n_words, runs, items)]. A task holds one block of searchers at a time."""
    loaded: list = []

    def run(texts: list) -> list[tuple[int, list[int], set]]:
        out = [(0, [], set())] * len(texts)
        for block in shared:
            if len(shared) == 1 and loaded:
                searchers = loaded[0]
            else:
                searchers = pickle.loads(block.value)
                loaded[:] = [searchers]
            for i, t in enumerate(texts):
                ws = words_of(t)
                runs, its = scan(searchers, ws)
                old = out[i][1]
                if old:
                    runs = merge(list(zip(runs[::2], runs[1::2])) + list(zip(old[::2], old[1::2])))
                out[i] = (len(ws), runs, its | out[i][2])
        return out

    return run


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): the hit word runs [start, end) of every document, flat, and
    the sorted ids of the items found.

    Documents are scanned where they lie; nothing is shuffled. The searchers are broadcast in blocks
    of at most ``block_bytes`` of benchmark text, and a task holds one block at a time. Null or empty
    texts have no words; an item without words has no window; an item without an id still hits, but isn't
    listed. Repeated rows are judged one by one. Other columns are ignored.
    """
    scanner = _scanner(ship(benchmark, item_col, item_text, block_bytes))

    def run(cols: dict) -> dict:
        found = scanner(cols["text"].to_pylist())
        return {"doc_id": cols["doc_id"], "n_words": [n for n, _, _ in found], "spans": [r for _, r, _ in found],
                "items": [sorted(x for x in its if x is not None) for _, _, its in found]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                    "doc_id long, n_words long, spans array<long>, items array<string>", run)


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated."""
    scanner = _scanner(ship(benchmark, block_bytes=block_bytes))

    def run(cols: dict) -> list[bool]:
        return [not is_contaminated(sum(r[1::2]) - sum(r[::2]), n) for n, r, _ in scanner(cols[text_col].to_pylist())]

    return keep_rows(docs, [text_col], run)


def contamination(hits: DataFrame) -> DataFrame:
    """The digest columns of ``find_hits``: words hit, items found, and the verdict (n_hit > 0 and
    20 * n_hit >= n_words)."""

    def run(cols: dict) -> dict:
        n_hit = [sum(s[1::2]) - sum(s[::2]) for s in cols["spans"].to_pylist()]
        its = cols["items"].to_pylist()
        return {"doc_id": cols["doc_id"], "n_words": cols["n_words"], "n_hit": n_hit,
                "n_items": [len(x) for x in its],
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in its],
                "contaminated": [is_contaminated(h, n) for h, n in zip(n_hit, cols["n_words"].to_pylist())]}

    return map_rows(hits, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
                          "contaminated boolean", run)


def contamination_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contamination figures of every document (see :func:`find_hits`, :func:`contamination`)."""
    return contamination(find_hits(docs, benchmark))
