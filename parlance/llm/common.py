"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in one Arrow batch. Texts reach 100,000 characters and more, so Spark's default of
#: 10,000 rows could put a gigabyte into a Python worker at once.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read only through Spark (the path may be in a remote store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, as ``spark.checkpoint.dir`` names it.

    Only in local mode may it be unset: a temporary folder then stands in for it, and is taken away at the
    end. Elsewhere that would be some machine's own folder, so a ValueError is raised.
    """
    sc = spark.sparkContext
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    own = sc._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not set_by_cluster and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not set_by_cluster:
            atexit.register(shutil.rmtree, made := tempfile.mkdtemp(prefix="parlance-"), ignore_errors=True)
        sc.setCheckpointDir(set_by_cluster or made)
        own = sc._jsc.sc().getCheckpointDir()
    return set_by_cluster or own.get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that one run writes."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Take a folder that ``written`` or ``fresh_path`` made out of the shared folder again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Map small Arrow batches; a lost executor only repeats its own partitions."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(over, schema)


def held_out(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 4 = 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
