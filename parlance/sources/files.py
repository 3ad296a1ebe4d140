"""File sources and sinks: catalogs and sessions as JSON lines, indexes as Parquet, results as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRODUCT = (
    "parent_asin STRING, title STRING, features ARRAY<STRING>, description ARRAY<STRING>, price STRING, "
    "categories ARRAY<STRING>, details MAP<STRING,STRING>, average_rating DOUBLE, rating_number BIGINT, store STRING"
)
SESSION = (
    "sample_id STRING, scenario_type STRING, category_bucket STRING, difficulty_bucket STRING, user_profile "
    "STRUCT<purchase_frequency STRING, average_prior_rating DOUBLE, rating_style STRING, preference_tags ARRAY<STRING>, "
    "summary STRING>, ground_truth STRUCT<parent_asin STRING>"
)
#: A change to the index format makes stored indexes unreadable, on purpose.
INDEX_VERSION = 1


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Products; of rows with one id, the last in file order stays."""
    rows = read_lines(spark, path, PRODUCT).withColumns(
        {"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()}
    )
    last = Window.partitionBy("parent_asin").orderBy(F.desc("_file"), F.desc("_at"), F.desc("_row"))
    return (
        rows.where("parent_asin IS NOT NULL")
        .withColumn("_n", F.row_number().over(last))
        .where("_n = 1")
        .drop("_file", "_at", "_row", "_n")
    )


def content_digest(spark: SparkSession, path: str) -> str:
    """The first 16 hex digits over the SHA-256 of every file under ``path``, in order of name."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h"))
    one = files.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "h"))), lambda x: x.h), ""), 256))
    return one.first()[0][:16]


def stored(spark: SparkSession, root: str, digest: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of an index, read if it is stored for this version and digest, else built and stored.

    A table that is missing or whose files can't be opened is built anew.
    """
    path = f"{root}/v={INDEX_VERSION}/digest={digest}/{name}"
    try:
        return spark.read.parquet(path)
    except (PySparkException, Py4JJavaError):
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def write_vectors(df: DataFrame, path: str, kind: str, digest: str) -> None:
    """Vectors clipped to the half-precision range, and one row that says what they belong to."""
    clipped = df.withColumn("v", F.transform("v", lambda x: F.greatest(F.least(x, F.lit(65000.0)), F.lit(-65000.0)).cast("float")))
    clipped.write.mode("overwrite").parquet(f"{path}/vectors")
    about = clipped.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("dim"))
    about.select(
        F.lit(INDEX_VERSION).alias("version"), F.lit(kind).alias("kind"), F.lit(digest).alias("digest"), "rows", "dim"
    ).write.mode("overwrite").parquet(f"{path}/meta")


def read_vectors(spark: SparkSession, path: str, digest: str) -> DataFrame | None:
    """Stored vectors, or None if version, digest, dimension or row count don't fit."""
    try:
        meta, vectors = spark.read.parquet(f"{path}/meta").first(), spark.read.parquet(f"{path}/vectors")
    except AnalysisException:
        return None
    if meta is None or meta.version != INDEX_VERSION or meta.digest != digest or not meta.dim or meta.dim <= 0:
        return None
    odd = vectors.agg(F.count("*"), F.count_if(F.size("v") != meta.dim)).first()
    return vectors if odd[0] == meta.rows and odd[1] == 0 else None


def write_summary(df: DataFrame, path: str) -> None:
    """A result of one row as indented JSON on the driver."""
    row = df.first()
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(row.asDict(recursive=True) if row else {}, indent=2, default=str) + "\n")
