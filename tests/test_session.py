"""Session settings and the scratch folder."""

import subprocess
import sys

import pytest

from shotbank import session
from shotbank.sources import fixtures as fx
from tests.conftest import ROOT, SF_SMALL


def test_set_values_are_respected(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        assert session.build_session() is spark
        assert spark.conf.get("spark.sql.session.timeZone") == "Europe/Paris"
        assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_no_scratch_folder_off_local_mode():
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from shotbank import session\n"
            "class Conf:\n    def get(self, k, d=None): return d\n"
            "class Ctx:\n    master = 'spark://host:7077'\n    def getConf(self): return Conf()\n"
            "class S:\n    sparkContext, conf = Ctx(), Conf()\n"
            "try: session.scratch_path(S(), 'x')\nexcept RuntimeError as e: print('raised', e)\n" % ROOT)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "raised set spark.checkpoint.dir" in out.stdout


def test_drop_scratch(spark, tmp_path):
    path = session.scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert session.drop_scratch(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        session.drop_scratch(spark, str(tmp_path))


def test_derived_tables_follow_their_input(spark, tmp_path):
    first = spark.range(3)
    first.write.parquet(str(tmp_path / "documents.parquet"))
    build = lambda: spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert fx.materialized(spark, str(tmp_path), "t", build).count() == 3
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert fx.materialized(spark, str(tmp_path), "t", build).count() == 5
    assert fx.table(spark, SF_SMALL, "documents").count() == 200
