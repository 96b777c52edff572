"""Versions of a stored index: what a reader sees while writers fail, race, append and compact."""

import pytest
from pyspark.sql import functions as F

from shotbank.operators import ivf
from shotbank.operators.knn import knn
from shotbank.sources import fixtures as fx
from shotbank.sources import index_store as store
from tests.conftest import SF_SMALL


def _rows(spark, root, number=None):
    index, _, _ = store.load(spark, root, number)
    return sorted((r.id, r.cell, list(r.embedding)) for r in index.collect())


@pytest.fixture(scope="module")
def kb(spark):
    return fx.knowledge_base(spark, SF_SMALL).select("id", "embedding")


@pytest.fixture
def root(spark, kb, tmp_path):
    cents = ivf.train_centroids(kb, nlist=4)
    store.create(ivf.assign_cells(kb, cents), cents, str(tmp_path / "ix"))
    return str(tmp_path / "ix")


def test_append_compact_rebuild_and_search(spark, kb, root):
    more = kb.select(F.concat(F.lit("more-"), "id").alias("id"), "embedding")
    assert store.version(spark, root).rows == kb.count()
    v = store.append(more, root, file_rows=5)
    assert (v.version, len(v.batches), v.rows, v.dimension) == (2, 2, 2 * kb.count(), 64)
    assert store.append(more.limit(0), root) == v
    both = _rows(spark, root)
    assert [r[1:] for r in both if r[0].startswith("more-")] == [r[1:] for r in both if not r[0].startswith("more-")]
    c = store.compact(spark, root)
    assert len(c.batches) == 1 and _rows(spark, root) == both and store.compact(spark, root) == c
    r = store.rebuild(spark, root, nlist=6)
    assert (r.version, r.nlist, r.rows) == (4, 6, 2 * kb.count()) and len(_rows(spark, root, 1)) == kb.count()
    index, cents, _ = store.load(spark, root)
    q = fx.query_batch(spark, SF_SMALL)
    assert sorted(ivf.bounded_search(q, index, cents, 3).collect()) == sorted(knn(q, kb.union(more), 3).collect())
    gone = store.vacuum(spark, root, keep=2)
    assert any(g.startswith("data/") for g in gone) and store.versions(spark, root) == [3, 4] and len(_rows(spark, root, 3)) == len(both)
    with pytest.raises(FileNotFoundError):
        store.load(spark, root, 1)


@pytest.mark.parametrize("step", ["_write", "_commit"])
def test_a_killed_rebuild_leaves_the_old_index(spark, root, monkeypatch, step):
    before = _rows(spark, root)

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(store, step, killed)
        store.rebuild(spark, root, nlist=3)
    assert _rows(spark, root) == before and store.version(spark, root).version == 1
    assert len(store.vacuum(spark, root)) == (1 if step == "_write" else 2)  # what the killed job left
    assert store.rebuild(spark, root, nlist=3).nlist == 3 and [r[0] for r in _rows(spark, root)] == [r[0] for r in before]


def test_the_second_of_two_writers_fails(spark, kb, root, monkeypatch):
    stale = store.version(spark, root)
    store.append(kb.limit(3), root)
    monkeypatch.setattr(store, "version", lambda *a: stale)
    with pytest.raises(store.Conflict):
        store.append(kb.limit(2), root)
    monkeypatch.undo()
    assert store.version(spark, root).rows == kb.count() + 3


def test_a_commit_that_was_cut_off_is_passed_over(spark, kb, root):
    with open(f"{root}/commits/0000000002", "w") as f:
        f.write('{"version": 2, "batc')
    assert store.version(spark, root).version == 1 and len(_rows(spark, root)) == kb.count()


def test_nothing_stored_and_other_dimensions(spark, kb, root, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x", [1.0, 2.0])], "id string, embedding array<float>"), root)
    assert store.version(spark, root).version == 1
