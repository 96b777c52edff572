import os
import random

import pytest

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              # names that the operators use inside
              "score double, h1 long, class_id long, key long, n int, count long, rep long, value string, uid long")
VOCAB = [a + b for a in ("the", "er", "on", "sh", "ti", "wh", "én", "ü") for b in ("th", "an", "ing", "re", "le", "st", "ou")]


def words(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def doc(i, text):
    return (i, text, "en", "src", len(text or ""), 0.5, 1, 2, 3, 4, 5, 6, "v", 7)


def awkward_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    long_text = " ".join(words(rng, 6000))
    base = words(rng, 120)
    near = list(base)
    near[60] = "changed"
    texts = [None, "", " \n ", "one", " ".join(base), " ".join(base), " ".join(near), long_text, "the the the the the " * 40,
             "mail jo.ann@mail.example.org or +1 (663) 555-6869", "😀 ▁ é\u0301 \x00 end"]
    rows = [doc(i, t) for i, t in enumerate(texts)]
    rows += [rows[4], rows[1], doc(None, "no id " + texts[4]), doc(None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark, sf):
    from shotbank.llm.common import table

    return table(spark, sf, "documents")
