"""Tables written once and read many times: the lineage cut between the parts of a larger job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None

#: Size of rows in a hash table per byte of their compressed columns. Sorted ids, NULLs and names of few values take 10 to 50 times their room on
#: disk, and Spark's estimate of a scan is the size on disk: tables of 100 MB and more went through the driver as broadcasts.
INFLATION = 16.0
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def estimate_in_memory(spark: SparkSession) -> None:
    """Scans are planned by what their rows take in memory, so that only small tables are broadcast. A larger factor of the session stays."""
    if float(spark.conf.get(_FACTOR, "1.0")) < INFLATION:
        spark.conf.set(_FACTOR, str(INFLATION))


def stage_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it is unset, a temporary folder of our own in
    local mode (one machine, as in tests) and None on a cluster, whose machines share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return None
    global _own_dir
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-shelfwise-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as parquet into the shared folder and read it back. Survives lost executors, is computed
    once, and gives the following joins real sizes to plan with. A cluster without a shared folder keeps the rows in
    executors' memory and disk, with their lineage."""
    spark = df.sparkSession
    root = stage_root(spark)
    if root is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{root}/shelfwise/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
