"""Repair of the turn structure of conversations by weighted CYK parsing over intervals.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``. The repair grammar derives the rows
as they are: every row is kept, given another role or deleted, rows are inserted, all at a cost. Its nonterminals
are intervals [p, q] of the four states below, in Chomsky normal form: [p, q] -> [p, r] [r, q] for two halves of a
span, and [p, q] -> row for one row with the insertions around it (the insertion closure). The cell of a span holds
for each nonterminal the cheapest (cost, audit); cells are combined bottom-up by span length. As [p, q] -> [p, r] [r, q]
holds for every split, a span has the same cell at whatever place it is split, and one split per span is parsed.

One (cost, audit) per nonterminal is enough although audits differ in length: where one audit is the start of another,
both hold the same row edits, so the longer one has insertions more and costs more; else the first letter that
differs decides, in any context.

A conversation of up to ``SMALL_ROWS`` rows and ``SMALL_BYTES`` is parsed in one task, many at a time. A larger one
is sorted by ranges and cut into blocks, whose cells are combined ``FAN`` at a time; only hashing its repaired
text, which SHA-256 defines from left to right, reads it in one stream.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shotbank.llm.common import _arrow_schema, map_rows, written

SMALL_ROWS = 4096
SMALL_BYTES = 8 << 20
#: Rows of a large conversation in one block, and cells that are combined in one step.
BLOCK = 1024
FAN = 64

# Costs and initials of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: States: nothing yet; after s; after u; after a. The first and the last are ends.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = range(4), (0, 3)
LEGAL = ("su", "ua", "au")
EDGE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
GOOD, CUT, MUST_GO = "0", "1", "2"

Cell = dict[tuple[int, int], tuple[int, str]]


def join(x: Cell, y: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out: Cell = {}
    for (p, r), (c, a) in x.items():
        for q in STATES:
            right = y.get((r, q))
            if right is not None:
                got = (c + right[0], a + right[1])
                if (p, q) not in out or got < out[p, q]:
                    out[p, q] = got
    return out


def _closure() -> Cell:
    """Any number of insertions."""
    once: Cell = {(p, p): (0, "") for p in STATES}
    for (p, role), q in STEP.items():
        if role != "s":
            once[p, q] = (INSERT, "I")
    cell = once
    while (more := join(cell, once)) != cell:
        cell = more
    return cell


CLOSURE = _closure()


@lru_cache(maxsize=None)  # 12 kinds of rows
def leaf(kind: str) -> Cell:
    """The cell of one row with the insertions around it; ``kind`` is its role's initial (x: none of the grammar's)
    and what is wrong with it."""
    initial, state = kind
    row: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if state != MUST_GO:
        more = TRUNCATED if state == CUT else 0
        for (p, role), q in STEP.items():
            options = [(KEEP + more, "K")] if role == initial else []
            options += [(REROLE + more, "R")] if role != "s" else []
            if options:
                row[p, q] = min(options)
    return join(join(CLOSURE, row), CLOSURE)


def combine(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, bottom-up by span length."""
    while len(cells) > 1:
        cells = [join(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def span(kinds: str) -> Cell:
    """The cell of the rows whose kinds (two letters each) follow one another."""
    return combine([leaf(kinds[i:i + 2]) for i in range(0, len(kinds), 2)])


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in ENDS)


@lru_cache(maxsize=50_000)
def parsed(kinds: str) -> tuple[int, str]:
    """(cost, audit) of a conversation of up to ``SMALL_ROWS`` rows."""
    return best(span(kinds)) if kinds else (0, "")


def pieces(audit: str) -> Iterator[tuple[str, int, int]]:
    """(edits, first, start) per row, and once more for what follows the last row: the insertions before the row
    with its own edit, the number of repaired rows before them, and whether the repaired rows start with s (0 or 1)."""
    odd = (len(audit) - audit.count("D")) % 2
    at, held = 0, ""
    for e in audit:
        held += e
        if e != "I":
            yield held, at, odd
            at += len(held) - (e == "D")
            held = ""
    yield held, at, odd


def lines(edits: str, first: int, odd: int, role: str | None, text: str | None) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows that ``edits`` gives; the place of a row tells its new role."""
    for e in edits:
        new = "user" if (first - odd) % 2 == 0 else "assistant"
        if e == "I":
            yield e, new, ""
        elif e == "R":
            yield e, new, text
        elif e == "K":
            yield e, role, text
        first += e != "D"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive): rows damaged by crc32(``conv_id:turn``) mod 20 (nulls: one space): 0
    drops the row (a row without text that is not ``alive`` stays, so that no conversation is lost), 1 empties its
    text, 2 removes ``[.!?]``, 3 repeats it, 4 sets role user."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                some("role").alias("role"), some("text").alias("text"), d.alias("d"))
    text = F.when(F.col("d") < 2, F.lit("")).when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("d") != 0).alias("alive"), copies.alias("copy")).drop("copy")


SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
REPAIRED = "conv_id long, place long, edit string, role string, text string"
ORDER = ["conv_id", "turn", "role", "text"]


def _faults(roles: list[str], texts: list[str]) -> str:
    """The kinds of a conversation's rows."""
    out, seen = [], set()
    for r, t in zip(roles, texts):
        shown = t.rstrip(EDGE)
        if not shown or (r, t) in seen:
            fault = MUST_GO
        else:
            fault = CUT if shown[-1] not in STOPS else GOOD
        seen.add((r, t))
        out.append((r[:1] if r[:1] in ("s", "u", "a") else "x") + fault)
    return "".join(out)


def _illegal(kinds: str) -> int:
    initials = kinds[::2]
    return sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1))


def _summary(conv, turns: list, roles: list[str], texts: list[str]) -> tuple:
    kinds = _faults(roles, texts)
    blank = sum(not t.strip(EDGE) for t in texts)
    faults = kinds[1::2]
    cost, audit = parsed(kinds)
    known = {t for t in turns if t is not None}
    sha, sep = hashlib.sha256(), ""
    for r, t, (edits, first, odd) in zip(roles + [None], texts + [None], pieces(audit)):
        for _, role, text in lines(edits, first, odd, r, t):
            sha.update(f"{sep}{role}:{text}".encode("utf-8", "replace"))
            sep = "\n"
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return (conv, gaps, blank, faults.count(MUST_GO) - blank, faults.count(CUT), _illegal(kinds), cost, audit, sha.hexdigest())


def _repaired(conv, turns: list, roles: list[str], texts: list[str]) -> Iterator[tuple]:
    _, audit = parsed(_faults(roles, texts))
    place = 0
    for r, t, (edits, first, odd) in zip(roles + [None], texts + [None], pieces(audit)):
        for e, role, text in lines(edits, first, odd, r, t):
            yield conv, place, e, role, text
            place += 1


def _over_conversations(rows: DataFrame, schema: str, fn) -> DataFrame:
    """``fn(conv_id, turns, roles, texts) -> output rows`` for each conversation; a task holds one at a time."""
    struct = StructType.fromDDL(schema)
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some, turns, roles, texts, out = None, False, [], [], [], []
        for batch in batches:
            for conv, turn, role, text, alive in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not some or conv != now:
                    if some:
                        out.extend(fn(now, turns, roles, texts))
                    now, some, turns, roles, texts = conv, True, [], [], []
                if alive:
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                if len(out) >= 2000:
                    yield _batch(out, arrow)
                    out = []
        if some:
            out.extend(fn(now, turns, roles, texts))
        yield _batch(out, arrow)

    return (rows.select(*ORDER, "alive").repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(run, struct))


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _shared(rows: DataFrame, small_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of small conversations, rows of large ones or None)."""
    large = written(rows.groupBy(F.col("conv_id").alias("large")).agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
        .where((F.col("rows") > small_rows) | (F.col("bytes") > SMALL_BYTES)).select("large"), "large")
    if large.isEmpty():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("large"))
    return rows.join(large, same, "left_anti"), written(rows.join(large, same, "left_semi"), "long")


def _kind(duplicate: Column) -> Column:
    shown = F.rtrim(F.col("text"), F.lit(EDGE))
    initial = F.substring("role", 1, 1)
    fault = (F.when((shown == "") | duplicate, MUST_GO)
             .when(F.substring(shown, -1, 1).isin(list(STOPS)), GOOD).otherwise(CUT))
    return F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault)


def _large(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per large conversation but for the hash, its rows with their edits)."""
    # ranges cut a conversation; the place in the input cuts even equal rows
    ordered = written(rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*ORDER, "salt")
                      .sortWithinPartitions(*ORDER, "salt").drop("salt").withColumn("pos", F.monotonically_increasing_id()), "ordered")
    alive = ordered.where("alive")
    pair = [F.xxhash64("role", "text"), F.xxhash64(F.lit("second"), "role", "text")]
    firsts = written(alive.groupBy(F.col("conv_id").alias("c"), pair[0].alias("h1"), pair[1].alias("h2"))
                     .agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    kinds = (alive.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (pair[0] == F.col("h1")) & (pair[1] == F.col("h2")), "left")
             .select("conv_id", "turn", "role", "text", "pos", _kind(F.coalesce(F.col("pos") > F.col("first"), F.lit(False))).alias("kind")))
    kinds = written(kinds.withColumn("block", F.expr(f"pos div {BLOCK}")), "kinds")
    blocks = kinds.groupBy("conv_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]), "").alias("kinds"))
    by = Window.partitionBy("conv_id").orderBy("block")
    blocks = written(blocks.select("*", (F.row_number().over(by) - 1).alias("span"),
                                   F.sum((F.length("kinds") / 2).cast("long")).over(by).alias("upto")), "blocks")

    def base(cols: dict) -> dict:
        ks = cols["kinds"].to_pylist()
        return {"conv_id": cols["conv_id"], "span": cols["span"], "cell": [_dump(span(k)) for k in ks],
                "first": [k[0] for k in ks], "last": [k[-2] for k in ks], "illegal": [_illegal(k) for k in ks]}

    shape = "conv_id long, span long, cell string, first string, last string, illegal long"
    cells = written(map_rows(blocks.select("conv_id", F.col("span").cast("long").alias("span"), "kinds"), shape, base), "cells")
    while cells.agg(F.max("span")).first()[0] or 0:
        cells = written(cells.groupBy("conv_id", F.expr(f"span div {FAN}").alias("part")).applyInPandas(_merge, shape), "cells")
    roots = map_rows(cells, "conv_id long, illegal long, cost long, audit string", _roots)
    faults = F.substring("kind", 2, 1)
    blank = F.rtrim(F.col("text"), F.lit(EDGE)) == ""
    counted = kinds.groupBy(F.col("conv_id").alias("c")).agg(
        F.count_if(blank).alias("blank"), F.count_if((faults == MUST_GO) & ~blank).alias("duplicate"),
        F.count_if(faults == CUT).alias("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("width"))
    turns = kinds.where("turn is not null").select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("t")).agg(F.count("*").alias("turns"))
    conversations = rows.select(F.col("conv_id").alias("o")).distinct()
    out = (conversations.join(counted, F.col("o").eqNullSafe(F.col("c")), "left").join(turns, F.col("o").eqNullSafe(F.col("t")), "left")
           .join(roots, F.col("o").eqNullSafe(F.col("conv_id")), "left"))
    none = F.lit(0).cast("long")
    summary = written(out.select(F.col("o").alias("conv_id"), F.coalesce(F.col("width") - F.coalesce("turns", none), none).alias("gaps"),
                                 *(F.coalesce(c, none).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
                                 F.coalesce("audit", F.lit("")).alias("audit")), "summary")
    # a row's number in its conversation: rows of the blocks before, and its place in the block
    start = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                          (F.col("upto") - (F.length("kinds") / 2).cast("long")).alias("start"))
    in_block = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("pos"))
    numbered = (kinds.withColumn("i", in_block).join(start, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
                .select("conv_id", (F.col("start") + F.col("i") - 1).alias("n"), "role", "text"))
    numbered = written(numbered, "numbered")
    edits = written(_edits(summary), "edits")
    edited = (edits.withColumnsRenamed({"conv_id": "c", "n": "m"})
              .join(numbered, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("m")), "left")
              .select(F.col("c").alias("conv_id"), F.col("m").alias("n"), "edits", "first", "odd", "role", "text"))
    return summary, edited


def _dump(cell: Cell) -> str:
    return json.dumps([[p, q, c, a] for (p, q), (c, a) in cell.items()])


def _load(dumped: str) -> Cell:
    return {(p, q): (c, a) for p, q, c, a in json.loads(dumped)}


def _merge(group):
    g = group.sort_values("span")
    seams = sum(x + y not in LEGAL for x, y in zip(g["last"][:-1], g["first"][1:]))
    return g.iloc[:1].assign(span=g["span"].iloc[0] // FAN, cell=_dump(combine([_load(c) for c in g["cell"]])),
                             last=g["last"].iloc[-1], illegal=g["illegal"].sum() + seams)


def _roots(cols: dict) -> dict:
    found = [best(_load(c)) for c in cols["cell"].to_pylist()]
    return {"conv_id": cols["conv_id"], "illegal": cols["illegal"], "cost": [c for c, _ in found], "audit": [a for _, a in found]}


def _edits(summary: DataFrame) -> DataFrame:
    """(conv_id, n, edits, first, odd) for each row of the large conversations, and one more at their ends."""
    struct = StructType.fromDDL("conv_id long, n long, edits string, first long, odd int")
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for conv, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, (edits, first, odd) in enumerate(pieces(audit)):
                    out.append((conv, n, edits, first, odd))
                    if len(out) >= 10_000:
                        yield _batch(out, arrow)
                        out = []
        yield _batch(out, arrow)

    return summary.select("conv_id", "audit").mapInArrow(run, struct)


def _hashes(edited: DataFrame) -> DataFrame:
    """(c, repaired_sha256): the repaired rows of each conversation, read in order and never held."""
    struct = StructType.fromDDL("c long, repaired_sha256 string")
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, sep, out = None, None, "", []
        for batch in batches:
            for conv, n, edits, first, odd, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if n == 0:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha, sep = conv, hashlib.sha256(), ""
                for _, r, t in lines(edits, first, odd, role, text):
                    sha.update(f"{sep}{r}:{t}".encode("utf-8", "replace"))
                    sep = "\n"
        if sha is not None:
            out.append((now, sha.hexdigest()))
        yield _batch(out, arrow)

    return edited.repartition("conv_id").sortWithinPartitions("conv_id", "n").mapInArrow(run, struct)


def repair(rows: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Per conversation of ``rows(conv_id, turn, role, text, alive)``: gaps, the rows by their first fault (blank,
    duplicate, truncated), illegal neighbours, the cost and audit of the cheapest repair and the SHA-256 of the
    repaired ``role:text`` lines.

    Rows count by turn, a null turn first; rows of one turn by role and text. A null conv_id is a conversation of its
    own. Rows that are not ``alive`` only name their conversation; one without other rows has zeros, no audit and the
    hash of the empty string. Roles of other initials can't be kept. Other columns are ignored. No rows give no rows.
    The result is the same for every ``small_rows``.
    """
    small, large = _shared(rows, small_rows)
    out = _over_conversations(small, SUMMARY, lambda *conversation: [_summary(*conversation)])
    if large is None:
        return out
    summary, edited = _large(large)
    hashes = _hashes(edited)
    return out.union(summary.join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"))


def repaired(rows: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of the repaired conversations in order, with the edit that gave
    each (K, R or I). See :func:`repair`."""
    small, large = _shared(rows, small_rows)
    out = _over_conversations(small, REPAIRED, _repaired)
    if large is None:
        return out
    _, edited = _large(large)

    def run(cols: dict) -> dict:
        found = {k: [] for k in ("conv_id", "place", "edit", "role", "text")}
        for conv, edits, first, odd, role, text in zip(*(cols[k].to_pylist() for k in ("conv_id", "edits", "first", "odd", "role", "text"))):
            for i, (e, r, t) in enumerate(lines(edits, first, odd, role, text)):
                for k, v in zip(found, (conv, first + i, e, r, t)):
                    found[k].append(v)
        return found

    return out.union(map_rows(edited, REPAIRED, run, slice_bytes=8 << 20))
