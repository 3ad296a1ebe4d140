"""The folder that all executors share, for checkpoints."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast, after they were counted.
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only in local mode may it be unset; a temporary one, taken
    away at the end, then stands in for it. On a cluster that would be some machine's own, so it is refused."""
    sc = spark.sparkContext
    given, own = spark.conf.get("spark.checkpoint.dir", None), sc._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not given and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not given:
            atexit.register(shutil.rmtree, made := tempfile.mkdtemp(prefix="parlance-"), ignore_errors=True)
        sc.setCheckpointDir(given or made)
        own = sc._jsc.sc().getCheckpointDir()
    return given or own.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage reliably, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Like ``checkpointed``, but as Parquet, a fraction of the size for rows of texts, in a folder that can be ``removed``."""
    folder = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, folders: list[str]) -> None:
    """Take away folders that nothing reads any more, and the shuffle files of plans that are gone."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def dealt(df: DataFrame, key: str, count: int, rows: int) -> DataFrame:
    """Deal ``count`` rows out by a key, some ``rows`` to a task, so that a task's memory does not grow with the table.
    Small files of many rows would else be read by one task, and narrow rows be joined into few partitions."""
    return df.repartition(max(8, -(-count // rows)), key)


def broadcast_if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A small table, computed once and counted; broadcast if it has no more than ``most`` rows."""
    made = checkpointed(df)
    return F.broadcast(made) if made.count() <= most else made
