"""Tables that are replaced whole, and logs that only grow, on any file system that Spark writes to."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version the current one, at once: the pointer is written beside the old one and renamed over it."""
    jvm = spark.sparkContext._jvm
    fs, new = file_system(spark, f"{path}/{POINTER}.{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    names.rename(fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")), overwrite)


def current_version(spark: SparkSession, path: str) -> str | None:
    fs, pointer = file_system(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    return spark.read.text(f"{path}/{POINTER}").first()[0]


def current(spark: SparkSession, path: str, table: str | None = None) -> DataFrame | None:
    """The rows of the current version (of one of its tables); None if nothing was ever published."""
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet("/".join(filter(None, (path, "versions", version, table))))


def published(tables: dict[str, DataFrame], path: str, keep: int = 2) -> str:
    """Replaces all tables under a path by new ones, together; the version's name.

    A version is a folder of its own. Readers see it only once all its tables
    are written; a writer that is killed leaves the old version current, and its
    remains go with the next version but `keep`. Readers of one of the versions kept are not disturbed.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
    before = current_version(spark, path)
    point_to(spark, path, version)
    fs, folder = file_system(spark, f"{path}/versions")
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    for old in names[: max(0, len(names) - keep)]:
        if old not in (before, version):
            fs.delete(file_system(spark, f"{path}/versions/{old}")[1], True)
    return version


def appended(df: DataFrame, path: str, batch: str) -> bool:
    """Adds the rows of a batch to a log, once: False if the batch is there already.

    The rows are written aside and renamed into place, so a batch that is tried
    again, or written twice at a time, is in the log whole and once. Nothing in the log is ever changed.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"{batch!r} is no name of a batch")
    spark = df.sparkSession
    fs, place = file_system(spark, f"{path}/batch={batch}")
    if fs.exists(place):
        return False
    aside = f"{path}/_aside-{batch}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(aside)
    own = file_system(spark, aside)[1]
    jvm = spark.sparkContext._jvm
    names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        names.rename(fs.makeQualified(own), fs.makeQualified(place), none)
    except Exception:  # another writer of the batch was first
        if not fs.exists(place):
            raise
        fs.delete(own, True)
        return False
    return True


def log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log, with their batch."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path).withColumn("batch", F.col("batch").cast("string"))
