import base64
import gzip
import hashlib
import random

from shotbank.llm import warc_revisit
from shotbank.llm.common import table
from shotbank.session import scratch_path

ROWS = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, "same"), (4, "http://c/", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n"),
        (7, "é", "é" * 50000), (8, "u", "line\r\n\r\nline\n"), (2, "http://b/\r\nx", "same"), (None, "n", "lone"), (None, "n", "same")]


def brute(rows, min_bytes=0):
    top = {}
    for i, _, h in rows:
        p = (h or "").encode()
        top[p] = max(top.get(p, -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= min_bytes and (-1 if i is None else i) != top[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top[p] if again else None))
    return sorted(out, key=str)


def digest(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_matches_brute_force(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as d", "2 as payload_bytes").repartition(3)
    assert digest(warc_revisit.archived(pages)) == brute(ROWS)
    assert digest(warc_revisit.archived(pages, min_bytes=5)) == brute(ROWS, 5)


def test_null_ids_and_ids_with_two_payloads(spark):
    rows = [(None, "a", "x"), (None, "b", "x"), (None, "c", "y"), (5, "d", "x"), (6, "e", "y"), (7, "f", "x"), (7, "g", "alone"),
            (6, "h", "x"), (7, "i", "y"), (8, "j", "z"), (None, "k", "z"), (None, "l", "n"), (None, "m", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc_revisit.archived(pages)
    assert digest(got) == brute(rows)
    assert sorted(r["url"] for r in got.collect()) == list("abcdefghijklm")


def test_whole_table(spark, sf):
    pages = table(spark, sf, "pages")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert digest(warc_revisit.archived(pages)) == brute(rows)


def test_archives_are_valid_warc(spark, tmp_path):
    path = scratch_path(spark, "warc-test")
    warc_revisit.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path, file_bytes=1000)
    import glob

    names = glob.glob(f"{path.removeprefix('file:')}/*/*.gz")
    assert len(names) > 1
    records = [x for n in names for x in warc_revisit.parse(gzip.open(n).read())]
    assert len(records) == len(ROWS)
    for head, payload in records:
        assert {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length", b"WARC-Target-URI"} <= set(head)
        if head[b"WARC-Type"] == b"revisit":
            assert not payload and b"WARC-Refers-To" in head and b"WARC-Profile" in head


def test_long_payloads_among_many_short_ones(spark):
    """Archives are cut by the bytes they hold, not by the mean payload."""
    import glob
    import os

    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(33, 1000)) for _ in range(200_000))
    rows = [(i, "u", f"short {i}") for i in range(3000)] + [(10_000 + i, "u", f"{i} {noise}") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = scratch_path(spark, "warc-long")
    warc_revisit.write_archives(pages, path, file_bytes=500_000)
    sizes = [len(gzip.open(n).read()) for n in glob.glob(f"{path.removeprefix('file:')}/*/*.gz")]
    assert len(sizes) > 6 and max(sizes) < 500_000 * 3
    assert digest(warc_revisit.read_archives(spark, path)) == brute(rows)
    assert os.path.basename(path).startswith("warc-long")


def test_empty_table(spark):
    assert warc_revisit.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
