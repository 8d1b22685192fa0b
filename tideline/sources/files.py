"""Files on any file system that Spark reaches, from the driver: existence, names, sizes, removal, small reads and writes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """The path's file system and the path, as the JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = hadoop_path(spark, path)
    return system.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a directory; none if it isn't there."""
    system, at = hadoop_path(spark, path)
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a directory with all that it holds, if it is there."""
    system, at = hadoop_path(spark, path)
    system.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    system, at = hadoop_path(spark, old)
    return system.rename(at, hadoop_path(spark, new)[1])
