import hashlib
import random

from shotbank.llm import wu_manber

from .conftest import DOC_SCHEMA, awkward_rows, doc, words


def brute(rows, items):
    out = []
    pats = []
    for item, t in items:
        w = wu_manber.words_of(t)
        m = min(13, len(w))
        pats += [(item, w[i:i + m]) for i in range(len(w) - m + 1 if m else 0)]
    for r in rows:
        w = wu_manber.words_of(r[1])
        hit, its = set(), set()
        for item, p in pats:
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    its.add(item)
        its = sorted(str(x) for x in its if x is not None)
        out.append((r[0], len(w), len(hit), len(its), hashlib.sha256(",".join(its).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case():
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.choice([1, 2, 5, 13, 14, 40])))) for i in range(25)]
    items += [(30, None), (31, "  ... "), (None, " ".join(words(rng, 20))), (3, items[3][1]), (11, items[10][1])]
    rows = awkward_rows()
    for i in range(40):
        w = words(rng, rng.choice([5, 40, 300]))
        for _ in range(rng.choice([0, 1, 3])):
            p = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w))
            w[a:a] = p[:rng.choice([12, 13, 99])]
        rows.append(doc(100 + i, ", ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows, items


def test_matches_brute_force(spark):
    rows, items = case()
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n_hit")
    want = brute(rows, items)
    assert sum(r[2] > 0 for r in want) > 10
    for block in (wu_manber.BLOCK_BYTES, 200):  # one pass over the benchmark, and many blocks of it
        got = wu_manber.contamination(wu_manber.find_hits(docs, bench, block_bytes=block)).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
        kept = wu_manber.clean(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in want if not r[5])


def test_empty_tables(spark, no_docs, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert wu_manber.contamination_of(no_docs, none).count() == 0
    assert not wu_manber.contamination_of(awkward, none).where("contaminated or n_hit > 0").count()
