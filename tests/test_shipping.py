"""The package reaches Python workers from any folder, and staging uses no local folder on a cluster."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark import StorageLevel

from shelfwise.sources import ship, stage

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_entry_runs_from_another_folder(tmp_path):
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(ROOT, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.entry(spark).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows " in out.stdout, out.stderr[-2000:]


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def _session(master, **conf):
    context = SimpleNamespace(master=master, getConf=lambda: _Conf())
    return SimpleNamespace(conf=_Conf(conf), sparkContext=context)


def test_stage_root():
    assert stage.stage_root(_session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert stage.stage_root(_session("yarn")) is None
    assert stage.stage_root(_session("local-cluster[2,1,1024]")) is None
    assert os.path.isdir(stage.stage_root(_session("local[4]")))


def test_without_a_shared_folder_rows_are_persisted(spark, monkeypatch):
    monkeypatch.setattr(stage, "stage_root", lambda spark: None)
    df = stage.stage(spark.range(5), "numbers")
    assert df.storageLevel == StorageLevel.MEMORY_AND_DISK or df.storageLevel.useDisk and df.storageLevel.useMemory
    assert df.count() == 5
    df.unpersist()


def test_staged_rows_come_from_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stage, "stage_root", lambda spark: str(tmp_path))
    df = stage.stage(spark.range(5), "numbers")
    assert df.count() == 5 and all(f.startswith(f"file://{tmp_path}/shelfwise/numbers-") for f in df.inputFiles())


def test_batches_for_workers_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    ship.ship(spark)
    sent = spark.range(0, 4_000, 1, 1).selectExpr("repeat('x', 4000) AS text").mapInArrow(sizes, "size bigint").collect()
    assert sum(r["size"] for r in sent) >= 16_000_000 and max(r["size"] for r in sent) < 5_000_000


def test_a_bound_of_the_session_is_kept(spark):
    before = spark.conf.get(ship._BATCH)
    try:
        spark.conf.set(ship._BATCH, "9m")
        ship.ship(spark)
        assert spark.conf.get(ship._BATCH) == "9m"
    finally:
        spark.conf.set(ship._BATCH, before)
