import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from shotbank.llm import token_alignment as ta
from shotbank.llm.common import table

from .conftest import awkward_rows, doc


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(ta.MODEL_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.MODEL_B)


def decoded(entry):
    """The bytes of a byte-level entry, by the usual table of the printable characters."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    table, n = {chr(b): b for b in keep}, 256
    for b in range(256):
        if b not in keep:
            table[chr(n)] = b
            n += 1
    return bytes(table[c] for c in entry)


def brute(rows, tools):
    """Per row, from whole texts, token by token."""
    tok, sp = tools
    out, links, pairs = [], [], Counter()
    for i, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw_a = [decoded(tok.id_to_token(x)) for x in a]
        raw_b = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            out.append([i, 0, 0, 0, 0, ""])
            links.append([])
            continue
        spans = []
        for raws in (raw_a, raw_b):
            at, mine = 0, []
            for r in raws:
                mine.append((at, at + len(r)))
                at += len(r)
            spans.append(mine)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, p, q = [], 0, 0
        for c in cuts:
            g = ([], [])
            while p < len(a) and spans[0][p][1] <= c:
                g[0].append(a[p])
                p += 1
            while q < len(b) and spans[1][q][1] <= c:
                g[1].append(b[q])
                q += 1
            groups.append(g)
        mine, j0 = [], 0
        for x, (s, e) in zip(a, spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                mine.append((x, b[j]))
                j += 1
        pairs.update(mine)
        links.append(mine)
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([i, len(a), len(b), len(groups), len(mine), hashlib.sha256(shown.encode()).hexdigest()])
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    return sorted((*o[:5], sum(pairs[p] == best[p[1]] for p in mine), sum(pairs[p] for p in mine), o[5])
                  for o, mine in zip(out, links)), pairs


def values(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                   r["groups_sha256"]) for r in df.collect())


TEXTS = ["<|endoftext|> </s> <s> <unk> <0x41>", "don't we'll  two   spaces\n\n \t x ", " lead", "▁ x", "a▁b", "  nbsp", "　 x",
         "日本語 テキスト 😀😀", "é \x00\x7f", "word " * 300, "x" * 900 + " y", "   ", " ", "\r\n a", "1234567890 3.14 !!!???"]


def frame(spark, awkward):
    return awkward.union(spark.createDataFrame([doc(100 + i, t) for i, t in enumerate(TEXTS)], awkward.schema)).repartition(4)


def test_brute_force(spark, awkward, tools):
    df = frame(spark, awkward)
    rows = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in df.collect()]
    want, pairs = brute(rows, tools)
    assert values(ta.align(df)) == want
    assert {(r["a"], r["b"]): r["links"] for r in ta.pair_counts(ta.chunks(df)).collect()} == dict(pairs)


def test_pieces_and_chunks_change_nothing(awkward, spark, monkeypatch):
    df = frame(spark, awkward).coalesce(1)
    v = ta.Vocabularies.of(ta._files(ta.MODEL_A, ta.MODEL_B))
    ids, texts = zip(*((r["doc_id"], r["text"] or "") for r in df.collect()))
    assert all(" " + " ".join(v.units(t)) == " " + t for t in texts) and max(len(v.units(t)) for t in texts) > 1000
    whole = ta.encode_chunk(v, list(ids), list(texts))
    for k, n in (("SLICE", 7), ("PIECE", 40)):
        monkeypatch.setattr(ta, k, n)
    cut = ta.encode_chunk(v, list(ids), list(texts))
    for k in whole:
        assert list(whole[k]) == list(cut[k]), k


def test_documents(spark, documents, tools, sf):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert values(ta.align(documents)) == brute(rows, tools)[0]


def test_empty_table(no_docs):
    assert ta.align(no_docs).count() == 0
