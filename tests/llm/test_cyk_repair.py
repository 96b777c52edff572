import hashlib
import itertools
import random
import zlib

import pytest

from shotbank.llm import cyk_repair
from shotbank.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"


def well_formed(roles):
    initials = "".join(r[:1] for r in roles)
    rest = initials[1:] if initials.startswith("s") else initials
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def cheapest(kinds):
    """All edits of a short conversation, by depth-first search: the least (cost, audit, lines)."""
    found = []

    def go(i, cost, audit, out):
        if cost > limit:
            return
        if len(audit) - i < 4 and len(out) < len(kinds) + 4:  # up to four insertions
            for r in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*out, (r, "")])
        if i == len(kinds):
            if well_formed([r for r, _ in out]):
                found.append((cost, audit, out))
            return
        role, text, state = kinds[i]
        go(i + 1, cost + 4, audit + "D", out)
        if state != "must":
            more = 3 if state == "cut" else 0
            go(i + 1, cost + more, audit + "K", [*out, (role, text)])
            for r in ("user", "assistant"):
                go(i + 1, cost + 3 + more, audit + "R", [*out, (r, text)])

    limit = 4 * len(kinds)  # deleting all rows
    go(0, 0, "", [])
    return min(found)


def brute(rows):
    """One conversation's (turn, role, text) rows: what :func:`cyk_repair.repair` returns."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, seen, n = [], [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        state = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        if state:
            n[state] += 1
        kinds.append((role, text, {"": "", "truncated": "cut"}.get(state, "must")))
        seen.append((role, text))
    cost, audit, out = cheapest(kinds)
    turns = {t for t, _, _ in rows if t is not None}
    return {**n, "cost": cost, "audit": audit, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def damaged(rows):
    """The damage that the query does, by its definition."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        d = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if d == 1:
            text = ""
        elif d == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(d, 1)
    return out


def awkward():
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "hello."), (7, None, "assistant", "late!"), (7, None, None, ""),
            (7, 3, "tool", "x"), (7, 3, "tool", "x"), (8, 0, "", " \t\n\x0b\x0c\r"), (9, 5, "system", "only."), (10, 1, "User", "é."),
            (11, 2**40, "assistant", "far?"), (11, -3, "user", "😀\x00."), (12, 0, "user", "a.\nassistant:b."), (13, 1, "system", "s."),
            (13, 2, "user", "no end"), (13, 3, "assistant", "end. ")]
    for conv in range(100, 220):
        for turn in rng.sample(range(9), rng.randint(1, 5)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]),
                         rng.choice(["Yes.", "No", "why?", "", " ", "word " * 400 + "."])))
    return rows


def by_conversation(rows):
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(tuple(rest))
    return groups


def check(got, original):
    groups = by_conversation(damaged(original))
    got = {r["conv_id"]: r.asDict() for r in got}
    assert set(got) == {r[0] for r in original}
    for conv, r in got.items():
        del r["conv_id"]
        assert r == brute(groups.get(conv, [])), conv


@pytest.mark.parametrize("small_rows", [cyk_repair.SMALL_ROWS, 0])
def test_brute_force(spark, small_rows):
    rows = awkward()
    frame = spark.createDataFrame([(*r, 1, "x", True) for r in rows], SCHEMA + ", pos long, kind string, alive boolean").repartition(3)
    check(cyk_repair.repair(cyk_repair.damage(frame), small_rows).collect(), rows)


def test_small_blocks_and_steps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(cyk_repair, "BLOCK", 3)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"{t}.", f"{t}"])) for t in range(300)]
    rows += [(2, None, "user", "same.")] * 40 + [(3, 1, "user", "x."), (3, 2, "assistant", "y.")]
    frame = cyk_repair.damage(spark.createDataFrame(rows, SCHEMA))
    one = {tuple(r) for r in cyk_repair.repair(frame).collect()}
    assert one == {tuple(r) for r in cyk_repair.repair(frame, small_rows=1).collect()}
    for small_rows in (cyk_repair.SMALL_ROWS, 1):
        out = cyk_repair.repaired(frame, small_rows).collect()
        for conv in (1, 2, 3):
            mine = sorted((r for r in out if r["conv_id"] == conv), key=lambda r: r["place"])
            assert well_formed([r["role"] for r in mine]) and [r["place"] for r in mine] == list(range(len(mine)))
            text = "\n".join(f"{r['role']}:{r['text']}" for r in mine)
            assert hashlib.sha256(text.encode()).hexdigest() in {r[-1] for r in one if r[0] == conv}


def test_a_span_has_one_cell_at_every_split():
    rng = random.Random(1)
    for _ in range(30):
        kinds = "".join(rng.choice("suax") + rng.choice("0012") for _ in range(rng.randint(2, 12)))
        whole = cyk_repair.span(kinds)
        for i in range(2, len(kinds), 2):
            assert cyk_repair.join(cyk_repair.span(kinds[:i]), cyk_repair.span(kinds[i:])) == whole


def test_given_conversations_and_empty_table(spark, sf):
    frame = table(spark, sf, "conversations")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect() if r["conv_id"] % 5 == 0]
    got = cyk_repair.repair(cyk_repair.damage(frame)).where("conv_id % 5 = 0").collect()
    check(got, rows)
    assert cyk_repair.repair(cyk_repair.damage(frame.limit(0))).count() == 0
