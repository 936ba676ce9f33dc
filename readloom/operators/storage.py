"""Intermediate tables in the folder that all executors share; deleted on ``release`` or when Python ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}
_made: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only in local mode."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _local_roots:
            _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="readloom-")
        root = _local_roots[sc.applicationId]
    return f"{root.rstrip('/')}/readloom-{sc.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table or set of files."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet and read back: cuts the lineage and fixes the rows, so a lost executor takes nothing with it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this session; results that read them are gone then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p, s in _made.items() if s is spark]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        _made.pop(path)


def _release_all() -> None:
    for spark in set(_made.values()):
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the session has ended already: what is local can still go
            for path in [p.removeprefix("file://") for p, s in _made.items() if s is spark]:
                shutil.rmtree(path, ignore_errors=True)
    for root in _local_roots.values():
        shutil.rmtree(root, ignore_errors=True)


atexit.register(_release_all)


def ranked(df: DataFrame, keys: list[str], to: str) -> DataFrame:
    """``df`` with the place of each row (from 1) in the order of ``keys``: a range sort over all tasks, no single-task window."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = stored(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    local = local.withColumn("_task", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND((1 << 33) - 1))
    # One row for each task, so the broadcast is bounded by the number of shuffle partitions.
    before = local.groupBy("_task").count().select("_task", (F.sum("count").over(Window.orderBy("_task")) - F.col("count")).alias("_before"))
    return local.join(F.broadcast(before), "_task").withColumn(to, F.col("_before") + F.col("_place") + 1).drop("_task", "_place", "_before", "_at")
