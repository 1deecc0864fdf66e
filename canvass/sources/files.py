"""File operations of the driver on any file system that Spark can write to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, as every executor understands it."""
    fs, p = _at(spark, path)
    uri = fs.makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it is missing."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def make_dir(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, old)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot move {old} to {new}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file; one that is there already stays."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        fs.create(p).close()
