"""Whitespace semantics equal Python's str.split()/strip() for every BMP code point."""

from pyspark.sql import functions as F

from shotbank.functions.text import WS_CHARS, collapse, first_line, last_line, preview, strip, tokens

PY_WS = {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_fixed_set_is_pythons():
    assert set(WS_CHARS) == PY_WS and len(WS_CHARS) == 29


def test_every_bmp_code_point(spark):
    cps = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, "a" + chr(c) + chr(c) + "b", chr(c) + "x" + chr(c)) for c in cps],
                               "cp int, inner string, edges string")
    got = df.select("cp", collapse("inner").alias("c"), strip("edges").alias("s"),
                    F.size(tokens("inner")).alias("n")).collect()
    for r in got:
        ch = chr(r.cp)
        assert r.c == " ".join(("a" + ch + ch + "b").split()), hex(r.cp)
        assert r.s == (ch + "x" + ch).strip(), hex(r.cp)
        assert r.n == len(("a" + ch + ch + "b").split()), hex(r.cp)


def test_mixed_runs_and_edges(spark):
    texts = ["  a \t\n b　 c\u0085 ", "  ", "", "x", "a​b", "😀  é\r\nz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(collapse("t")).collect()]
    assert got == [" ".join(t.split()) for t in texts]


def test_preview_and_lines(spark):
    df = spark.createDataFrame([("q\nmid\nans", "x" * 101), ("single", "short")], "t string, r string")
    rows = df.select(first_line("t"), last_line("t"), preview("r", 100)).collect()
    assert rows[0][0] == "q" and rows[0][1] == "ans" and rows[0][2] == "x" * 100 + "..."
    assert rows[1][0] == "single" and rows[1][1] == "single" and rows[1][2] == "short"
