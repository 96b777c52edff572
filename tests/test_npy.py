"""Vectors in .npy files: ranges, parts, headers, metadata and what goes wrong."""

import json

import numpy as np
import pytest

from shotbank.sources import fixtures as fx
from shotbank.sources import npy
from tests.conftest import SF_SMALL


def _matrix(rows, width, dtype="f4"):
    return np.random.default_rng(rows).normal(size=(rows, width)).astype(dtype)


@pytest.mark.parametrize("dtype", ["<f4", "<f8", ">f4", "<f2"])
def test_a_file_is_read_by_ranges(spark, tmp_path, dtype):
    m = _matrix(103, 7, dtype)
    np.save(tmp_path / "v.npy", m)
    got = npy.load_npy(spark, str(tmp_path / "v.npy"), range_bytes=7 * m.itemsize * 10)
    assert got.rdd.getNumPartitions() == 11
    rows = sorted(got.collect())
    assert [r.pos for r in rows] == list(range(103))
    assert np.array_equal(np.array([r.embedding for r in rows], "f4"), m.astype("f4"))


def test_metadata_stands_beside_its_vector(spark, tmp_path):
    m = _matrix(5, 3)
    np.save(tmp_path / "v.npy", m)
    meta = [{"id": f"x{i}", "question": f"é {i}\n", "task": None} for i in range(5)]
    (tmp_path / "m.json").write_text(json.dumps(meta, indent=2, ensure_ascii=False), encoding="utf-8")
    got = sorted(npy.load_npy(spark, str(tmp_path / "v.npy"), str(tmp_path / "m.json")).collect())
    assert [(r.pos, r.id, r.question) for r in got] == [(i, f"x{i}", f"é {i}\n") for i in range(5)]
    (tmp_path / "m.json").write_text("[{\"id\": \"x\"}]")
    with pytest.raises(ValueError):
        npy.load_npy(spark, str(tmp_path / "v.npy"), str(tmp_path / "m.json"))


def test_round_trip_against_parquet_and_numpy(spark, tmp_path):
    kb = fx.knowledge_base(spark, SF_SMALL).select("pos", "embedding")
    want = sorted(kb.selectExpr("pos", "cast(embedding as array<float>) as embedding").collect())
    for parts in (3, 1, 5):  # written again over itself
        assert npy.save_npy(kb, str(tmp_path / "out"), "pos", parts=parts) == len(want)
    got = sorted(npy.load_npy(spark, str(tmp_path / "out"), range_bytes=64 * 4 * 9).collect())
    assert [list(r.embedding) for r in got] == [list(r.embedding) for r in want]
    whole = np.concatenate([np.load(p) for p in sorted((tmp_path / "out").glob("*.npy"))])
    assert np.array_equal(whole, np.array([r.embedding for r in want], "f4"))
    assert not list((tmp_path / "out").glob("_parts*"))


def test_what_cannot_be_read_or_written(spark, tmp_path):
    with pytest.raises(Exception, match="no vectors"):
        npy.load_npy(spark, str(tmp_path / "none.npy")).count()
    np.save(tmp_path / "flat.npy", np.zeros(4))
    with pytest.raises(Exception, match="not rows of floats"):
        npy.load_npy(spark, str(tmp_path / "flat.npy")).count()
    np.save(tmp_path / "cut.npy", _matrix(20, 4))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="ends before"):
        npy.load_npy(spark, str(tmp_path / "cut.npy")).count()
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "pos long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="dimensions differ"):
        npy.save_npy(uneven, str(tmp_path / "bad"), "pos", parts=1)
    assert not list((tmp_path / "bad").glob("*.npy"))
